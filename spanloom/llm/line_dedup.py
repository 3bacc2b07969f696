"""Line dedup: an exact set-similarity join over the lines of all documents, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity (how many words of all rows are in their hash bucket, in
256 ranks that hold equally many words; the table has a fixed size of 2^18 buckets), rarest first, then by hash. Two sets of Jaccard similarity t or
more share a word within their first n - ceil(t n) + 1 words (prefix filter); their first common word leaves room for the
overlap that t asks for (positional filter, which implies that their sizes differ by a factor t at most: length filter);
and the xor of their parity sketches (64 bits, 128 of long lines), where each word flips one bit, has at most as many bits as
their difference may have words. What passes is verified on whole word sets. A line that has an earlier
similar one (judged on the input) is removed.

Equal lines collapse to their earliest first, so copies cost nothing. Entries (one for each line and prefix word) that
pass the filters with no other entry of their word drop out in one join by word, of which a task may split the
fullest words (a semi join, so a dense group costs no rows). Of the few that are left, every line is held against the
earliest line that shares a prefix word, one pair a word; only lines that this leaves in place are paired with all
earlier holders of one of their words that pass the filters. A dense group so costs about its size, not its square.

Defined cases: null and empty texts have one empty line; lines without words stay; null doc_ids count as the largest
long. Lines are ordered by doc_id, then by the hash of their document's text, then by line number: rows that share a
doc_id keep their own lines. Rows equal in doc_id and text count as one and get equal results. Other columns are ignored
(or pass through `without_repeated_lines`, whatever their names); empty tables give no rows. Word order and the collapse
of equal lines use hashes of 64 and 128 bits; verification compares 64-bit hashes of the words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.runtime import discard, written

#: Blanks other than the space, which stand for it.
BLANKS = "\t\v\f\r"
#: Hash buckets whose counts stand for the rarity of their words, and ranks of these.
RARITY_BITS, RANK_BITS = 18, 8
#: Buckets whose counts share a row, so that a task's groups fit the small map that Spark's aggregation tries first.
LANES = 4
#: Lines of more words have sketches of 128 bits.
LONG = 80
#: Size of the bit table that tells which lines are likely to be verified.
MARK_BITS = 1 << 20
LAST = (1 << 63) - 1
LEAST = -(1 << 63)


def spaced(text: Column) -> Column:
    """Other blanks become spaces; most texts have none and are not rewritten."""
    any_of = F.lit(False)
    for b in BLANKS:
        any_of = any_of | F.contains(text, F.lit(b))
    return F.when(any_of, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def word_hashes(line: Column) -> Column:
    """Distinct 64-bit hashes of the words between spaces."""
    return F.array_except(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def counted(texts: DataFrame, share: int = 8) -> DataFrame:
    """One of so many rows, drawn by the hash of their names, for callers who bring ranks of their own: any order of the words gives the same result. `rarity` counts all rows."""
    return texts.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0)


def rarity(texts: DataFrame) -> Column:
    """An array by hash bucket (a hash's high bits): what turns its highest bits into the bucket's rank. Every word of every row counts."""
    n, half = 1 << RARITY_BITS, 1 << RANK_BITS - 1
    words = texts.select(F.explode(F.split(F.replace(spaced(F.col("t")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))  # not all texts need what `spaced` rewrites, and that is slow
    buckets = words.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - RARITY_BITS).alias("b"))
    lanes = [F.count_if(F.col("b").bitwiseAND(F.lit(LANES - 1)) == k).alias(f"n{k}") for k in range(LANES)]
    found = buckets.groupBy(F.shiftright("b", LANES.bit_length() - 1).alias("g")).agg(*lanes).toArrow()  # at most 2^RARITY_BITS / LANES rows
    counts = np.zeros((n // LANES, LANES), np.int64)
    counts[found["g"].to_numpy()] = np.stack([found[f"n{k}"].to_numpy() for k in range(LANES)], axis=1)
    counts = counts.ravel()
    order = np.argsort(counts, kind="stable")
    before = np.cumsum(counts[order]) - counts[order]
    rank, turn = before * 2 * half // max(1, counts.sum()), np.empty(n, np.int64)
    turn[order] = ((rank ^ half ^ order >> RARITY_BITS - RANK_BITS) + half) % (2 * half) - half  # longs are signed: rank 0 has the sign bit
    return F.split(F.lit(",".join(map(str, turn.tolist()))), ",").cast("array<bigint>")


def by_rarity(line: Column, ranks: Column) -> Column:
    """Distinct words as longs that sort by rarity, then hash. All have a rank; only arrays that can't hold null are sorted as longs, not as objects."""
    rank = lambda h: F.coalesce(F.get(ranks, F.shiftrightunsigned(h, 64 - RARITY_BITS)), F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(word_hashes(line), lambda h: h.bitwiseXOR(F.shiftleft(rank(h), 64 - RANK_BITS))))


def parity(codes: Column, one: Column | None = None) -> Column:
    """64 bits, of which each word flips one; `one`: only words do that have a further bit set."""
    spot = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint") if one is None else F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(1).cast("bigint")), spot(c))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def share(n: Column, up: int, down: int) -> Column:
    """ceil(n * up / down) in whole numbers."""
    return F.expr(f"CAST(({n} * {up} + {down - 1}) DIV {down} AS INT)")


def marked(h: Column, wanted: DataFrame) -> Column:
    """Whether the bit of a hash is set in a table of MARK_BITS bits that has those of all wanted hashes (column h): spares most others a shuffle."""
    part, bit = (lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit((MARK_BITS >> 6) - 1))), (lambda x: x.bitwiseAND(F.lit(63)).cast("int"))
    found = wanted.groupBy(part(F.col("h")).alias("p")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("h")))).alias("b")).collect()  # at most MARK_BITS / 64 rows
    table = {r["p"]: r["b"] for r in found}
    bits = F.split(F.lit(",".join(str(table.get(p, 0)) for p in range(MARK_BITS >> 6))), ",").cast("array<bigint>")
    return F.call_function("shiftright", F.get(bits, part(h)), bit(h)).bitwiseAND(F.lit(1)) == 1


def reach(n: str, spot: str, up: int, down: int) -> Column:
    """The most words that a line may have which shares the word at this place (from 1) of a line of n words as their first common one."""
    return F.expr(f"CAST(((1 + {n} - {spot}) * {up + down} - {n} * {up}) DIV {up} AS BIGINT)")


def fits(up: int, down: int, a: str = "a.", b: str = "b.") -> Column:
    """Positional and parity filters of two entries of one word. m holds n and the entry's reach; being within reach of each other implies the length filter."""
    differ = lambda c: F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    n, most = (lambda x: F.shiftright(F.col(f"{x}m"), 32)), (lambda x: F.col(f"{x}m").bitwiseAND(F.lit(0xFFFFFFFF)))
    all_ = lambda x: F.col(f"{x}low").bitwiseXOR(F.col(f"{x}high"))
    apart = F.when((n(a) > LONG) & (n(b) > LONG), differ("low") + differ("high")).otherwise(F.bit_count(all_(a).bitwiseXOR(all_(b))))
    return (n(b) <= most(a)) & (n(a) <= most(b)) & (apart * (up + down) <= (n(a) + n(b)) * (down - up))


def similar(pairs: DataFrame, words: DataFrame, up: int, down: int) -> DataFrame:
    """Of (a, b) pairs of lines those whose words have the asked similarity: column line (the later one)."""
    one = pairs.join(words.select(F.col("line").alias("a"), F.col("words").alias("aw")), "a")
    both = one.join(words.select(F.col("line").alias("b"), F.col("words").alias("bw")), "b")
    return both.where(F.size(F.array_intersect("aw", "bw")) * (up + down) >= (F.size("aw") + F.size("bw")) * up).select(F.col("a").alias("line")).distinct()


class Rows:
    """Names of rows and of their lines, which sort by key, then by the hash of the text, then by line number.

    A long if keys are few enough and tell rows apart (key * 2^24 + line number), else bytes. This changes cost only.
    """

    def __init__(self, docs: DataFrame, key: str, text: str):
        named = docs.select(self.key(docs[key]).alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
        least, most, copies = named.groupBy("k").agg(F.count("*").alias("n")).agg(F.min("k"), F.max("k"), F.max("n")).first()
        self.plain = least is None or (least >= 0 and most < 1 << 39)
        if self.plain and copies and copies > 1:
            tags = named.groupBy("k").agg(F.min(F.xxhash64("t")).alias("lo"), F.max(F.xxhash64("t")).alias("hi"))
            self.plain = tags.where("lo <> hi").limit(1).count() == 0

    @staticmethod
    def key(k: Column) -> Column:
        return F.coalesce(k.cast("bigint"), F.lit(LAST))

    def row(self, k: Column, text: Column) -> Column:
        if self.plain:
            return self.key(k)
        part = lambda x: F.unhex(F.lpad(F.hex(x.bitwiseXOR(F.lit(LEAST))), 16, "0"))
        return F.concat(part(self.key(k)), part(F.xxhash64(F.coalesce(text, F.lit("")))))

    def line(self, row: Column, j: Column) -> Column:
        """Null if a long can't name it, which `repeated_lines` looks out for."""
        return F.when(j < 1 << 24, F.shiftleft(row, 24).bitwiseOR(j.cast("bigint"))) if self.plain else F.concat(row, F.unhex(F.lpad(F.hex(j), 8, "0")))

    def row_of(self, line: Column) -> Column:
        return F.shiftright(line, 24) if self.plain else F.substring(line, 1, 16)

    def number(self, line: Column) -> Column:
        return (line.bitwiseAND(F.lit((1 << 24) - 1)) if self.plain else F.conv(F.hex(F.substring(line, 17, 4)), 16, 10)).cast("int")


def repeated_lines(docs: DataFrame, rows: Rows, up: int, down: int, key: str, text: str, ranks: Column | None = None) -> DataFrame:
    """The lines to remove: row (its name) and gone (array of line numbers from 0, in order), read from `written` tables alone."""
    texts = docs.select(rows.row(docs[key], docs[text]).alias("row"), docs[text].alias("t"))
    ranks = rarity(texts) if ranks is None else ranks

    def lined(some: DataFrame) -> DataFrame:
        split = some.select("row", F.posexplode(F.split("t", "\n", -1)).alias("j", "l")).where(F.ltrim("l", F.lit(" " + BLANKS)) != "")  # from the right it would go through the whole line
        return split.select(rows.line(F.col("row"), F.col("j")).alias("line"), "l", F.xxhash64("l").alias("x"), F.xxhash64(F.lit("y"), "l").alias("y"))

    lines = lined(texts)
    coded = lines.select("line", "x", "y", by_rarity(spaced(F.col("l")), ranks).alias("codes"))
    prefix = F.slice("codes", 1, F.size("codes") - share("size(codes)", up, down) + 1)
    low = F.when(F.size("codes") > LONG, parity(F.col("codes"), F.lit(1)))
    # none is null, so that no condition on them moves up to where words are hashed
    values = {"n": F.coalesce(F.size("codes"), F.lit(0)), "low": F.coalesce(low, F.lit(0).cast("bigint")), "all": F.coalesce(parity(F.col("codes")), F.lit(0).cast("bigint")), "prefix": F.coalesce(prefix, F.array().cast("array<bigint>"))}
    short = written(coded.select("line", "x", "y", *[v.alias(c) for c, v in values.items()]), hashes=True)
    names = short.select("line", "x", "y")
    if rows.plain and names.where("line IS NULL").limit(1).count():
        rows.plain = False  # a text has 2^24 lines or more
        discard(short)
        return repeated_lines(docs, rows, up, down, key, text, ranks)
    # equal lines collapse to the earliest; the hashes have 128 bits together
    sets = short.groupBy("x", "y", "n", "low", "all", "prefix").agg(F.min("line").alias("line"))  # the rest follows from x and y; as keys they need no sort
    spots = sets.select("line", "n", "low", F.col("low").bitwiseXOR(F.col("all")).alias("high"), F.posexplode_outer("prefix").alias("spot", "word"))
    m = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(reach("n", "(spot + 1)", up, down))
    entries = spots.select("word", "line", "low", "high", m.alias("m")).where("word IS NOT NULL AND line IS NOT NULL AND m IS NOT NULL")
    meets = (F.col("a.word") == F.col("b.word")) & fits(up, down)
    met = written(entries.alias("a").join(entries.alias("b"), meets & (F.col("a.line") != F.col("b.line")), "left_semi"), hashes=True)
    wanted = met.select(F.col("line").alias("one")).distinct()
    some = texts.where(marked(F.xxhash64("row"), wanted.select(F.xxhash64(rows.row_of(F.col("one"))).alias("h"))))
    likely = lined(some).where(marked(F.xxhash64("line"), wanted.select(F.xxhash64("one").alias("h"))))
    words = written(likely.join(wanted, F.col("line") == F.col("one"), "left_semi").select("line", "x", "y", word_hashes(spaced(F.col("l"))).alias("words")))
    earlier = F.col("b.line") < F.col("a.line")
    lead = met.groupBy("word").agg(F.min(F.struct("line", "low", "high", "m")).alias("p")).select("word", "p.*")
    led = met.alias("a").join(lead.alias("b"), meets & earlier).select(F.col("a.line").alias("a"), F.col("b.line").alias("b")).distinct()
    gone = written(similar(led, words, up, down))
    left = met.join(gone, "line", "left_anti")
    crossing = left.alias("a").join(met.alias("b"), meets & earlier).select(F.col("a.line").alias("a"), F.col("b.line").alias("b")).distinct()
    late = written(similar(crossing, words, up, down))
    discard(met)
    # a line goes if it is not the earliest of its equals, or if that one goes
    dropped = words.select("line", "x", "y").join(gone.unionByName(late), "line", "left_semi").select("x", "y", F.lit(None).alias("earliest"), F.lit(True).alias("drop"))
    copied = names.groupBy("x", "y").agg(F.min("line").alias("earliest"), F.count("*").alias("copies")).where("copies > 1").select("x", "y", "earliest", F.lit(False).alias("drop"))
    status = copied.unionByName(dropped).groupBy(F.col("x").alias("sx"), F.col("y").alias("sy")).agg(F.max("earliest").alias("earliest"), F.max("drop").alias("drop"))
    removed = names.join(status, (F.col("x") == F.col("sx")) & (F.col("y") == F.col("sy"))).where(F.col("drop") | (F.col("line") != F.col("earliest")))
    return removed.groupBy(rows.row_of(F.col("line")).alias("rk")).agg(F.sort_array(F.collect_list(rows.number(F.col("line")))).alias("gone"))


def without_repeated_lines(docs: DataFrame, up: int = 4, down: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns kept, with repeated lines taken out of the text."""
    rows = Rows(docs, key, text)
    found = repeated_lines(docs, rows, up, down, key, text)
    removed = written(found)
    discard(found)  # the tables that it reads
    k, t = (F.col(f"c{docs.columns.index(c)}") for c in (key, text))
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", rows.row(k, t))
    # by its compressed files the small table seems fit for a broadcast up to some 10 times the memory asked for
    joined = named.join(removed.hint("merge"), F.col("row") == F.col("rk"), "left").withColumn("lines", lines_of(t))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.when(F.col("gone").isNull(), t).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select(*[(cut if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def line_removals(docs: DataFrame, up: int = 4, down: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_removed and removed_lines (their numbers from 0, in order) per row."""
    rows = Rows(docs, key, text)
    removed = repeated_lines(docs, rows, up, down, key, text)
    whole = F.coalesce(docs[text], F.lit(""))
    counted = docs.select(docs[key].alias("id"), rows.row(docs[key], docs[text]).alias("row"), (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n"))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    joined = counted.join(removed, F.col("row") == F.col("rk"), "left")
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"), gone.alias("removed_lines"))
