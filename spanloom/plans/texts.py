"""Queries over text functions, packing, label data, extraction, window and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.plans.fixtures import CHAPTER, Fixtures, keeps, running
from spanloom.plans.registry import query


@query("n1_ascii_text", r"SELECT doc_id AS chapter_idx, md5(regexp_replace(translate(translate(text, '‘’“”', '''''""'), '‐‑‒–—―', '------'), '[^\x00-\x7F]', '', 'g')) AS digest FROM documents")
def n1(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", F.md5(tx.ascii_text(F.col("original"))).alias("digest"))


@query("n2_joined_lines", r"SELECT doc_id AS chapter_idx, md5(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '\n+', ' ', 'g')) AS digest FROM documents")
def n2(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", F.md5(F.regexp_replace(F.regexp_replace("original", "\n{3,}", "\n\n"), "\n+", " ")).alias("digest"))


@query("n3_squeezed_blanks", r"SELECT doc_id AS chapter_idx, md5(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def n3(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", F.md5(tx.squeezed(F.col("original"))).alias("digest"))


def number_in_words(n: Column) -> Column:
    """1 to 999,999 in words, as headings spell it: with a hyphen, and with `and` before what follows a hundred."""
    units, tens = (F.array(*map(F.lit, x)) for x in (tx.UNITS, tx.TENS))
    small = lambda x: F.when(x < 20, F.get(units, x)).otherwise(F.concat(F.get(tens, (x / 10 - 2).cast("int")), F.when(x % 10 > 0, F.concat(F.lit("-"), F.get(units, x % 10))).otherwise("")))

    def below_thousand(x: Column) -> Column:
        hundreds, rest = (x / 100).cast("int"), x % 100
        return F.concat_ws(" and ", F.when(hundreds > 0, F.concat(F.get(units, hundreds), F.lit(" hundred"))), F.when((rest > 0) | (x == 0), small(rest)))

    thousands = (n / 1000).cast("int")
    return F.concat_ws(" ", F.when(thousands > 0, F.concat(below_thousand(thousands), F.lit(" thousand"))), F.when((n % 1000 > 0) | (n == 0), below_thousand((n % 1000).cast("int"))))


ROMAN_DIGITS = [["", "M", "MM", "MMM"], *[["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c] for a, b, c in ("CDM", "XLC", "IVX")]]


def roman_of(n: Column) -> Column:
    """1 to 3,999 as a numeral."""
    return F.concat(*[F.get(F.array(*map(F.lit, digits)), (n / 10**k).cast("int") % 10) for k, digits in zip((3, 2, 1, 0), ROMAN_DIGITS, strict=True)])


WORD_LISTS = "WITH l AS (SELECT " + ", ".join(f"[{', '.join(repr(w) for w in x)}] AS {name}" for name, x in (("u", tx.UNITS), ("t", tx.TENS))) + ")"
SMALL = "CASE WHEN {0} < 20 THEN u[{0} + 1] ELSE t[{0} // 10 - 1] || CASE WHEN {0} % 10 > 0 THEN '-' || u[{0} % 10 + 1] ELSE '' END END"
HUNDREDS = "concat_ws(' and ', CASE WHEN {0} >= 100 THEN u[{0} // 100 + 1] || ' hundred' END, CASE WHEN {0} % 100 > 0 OR {0} = 0 THEN " + SMALL.replace("{0}", "({0} % 100)") + " END)"
IN_WORDS = f"concat_ws(' ', CASE WHEN n >= 1000 THEN {HUNDREDS.replace('{0}', '(n // 1000)')} || ' thousand' END, CASE WHEN n % 1000 > 0 OR n = 0 THEN {HUNDREDS.replace('{0}', '(n % 1000)')} END)"


@query("p3_number_words", f"{WORD_LISTS} SELECT chapter_idx, {IN_WORDS} AS words, n FROM (SELECT doc_id AS chapter_idx, (doc_id * 37) % 1000000 AS n FROM documents), l")
def p3(fx: Fixtures) -> DataFrame:
    """Chapter numbers spelled out as a heading would, and read again."""
    words = fx.chapters.select("chapter_idx", number_in_words(F.col("chapter_idx") * 37 % 1000000).alias("words"))
    return words.select("chapter_idx", "words", tx.number_words(F.col("words")).alias("n"))


ROMAN_SQL = " || ".join(f"[{', '.join(repr(d) for d in digits)}][n // {10**k} % 10 + 1]" for k, digits in zip((3, 2, 1, 0), ROMAN_DIGITS, strict=True))


@query("p4_roman_numerals", f"SELECT chapter_idx, CASE WHEN chapter_idx % 2 = 0 THEN {ROMAN_SQL} ELSE lower({ROMAN_SQL}) END AS numeral, n FROM (SELECT doc_id AS chapter_idx, doc_id % 3999 + 1 AS n FROM documents)")
def p4(fx: Fixtures) -> DataFrame:
    """Chapter numbers as numerals, in capitals or not, and read again."""
    numeral = roman_of(F.col("chapter_idx") % 3999 + 1)
    made = fx.chapters.select("chapter_idx", F.when(F.col("chapter_idx") % 2 == 0, numeral).otherwise(F.lower(numeral)).alias("numeral"))
    return made.select("chapter_idx", "numeral", tx.roman_number(F.col("numeral")).alias("n"))


@query("p5_titles", "SELECT book_id, chapter_idx, 'Book ' || (chapter_idx % 3 + 1) || CASE WHEN chapter_idx % 2 = 0 THEN ' - ' || book_id ELSE '' END || ' | Chapter ' || chapter_idx || CASE WHEN chapter_idx % 5 = 0 THEN ': Five' ELSE '' END AS title FROM chapters")
def p5(fx: Fixtures) -> DataFrame:
    i = F.col("chapter_idx")
    return fx.chapters.select(*CHAPTER, tx.title_text(i % 3 + 1, F.when(i % 2 == 0, F.col("book_id")), i, F.when(i % 5 == 0, F.lit("Five"))).alias("title"))


SMALL_LETTERS, CAPITALS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def in_capitals(title: Column) -> Column:
    return F.translate(title, SMALL_LETTERS, CAPITALS)


def editions(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """book_id, chapter_idx, title of two editions of all chapters: the first words, in one of them here and there in capitals or longer. Each lacks some chapters."""
    i, base = F.col("chapter_idx"), F.array_join(F.slice(F.split("original", " ", -1), 1, 3), " ")
    one = F.when(i % 4 == 0, in_capitals(base)).otherwise(base)
    two = F.when(i % 4 == 1, in_capitals(base)).when(i % 4 == 2, F.concat(base, F.lit(" again"))).otherwise(base)
    return tuple(fx.chapters.where(i % lacking > 0).select(*CHAPTER, title.alias("title")) for title, lacking in ((one, 5), (two, 7)))


CAPS = f"translate({{0}}, '{SMALL_LETTERS}', '{CAPITALS}')"
BASE = "array_to_string(string_split(original, ' ')[1:3], ' ')"
EDITIONS = f"""WITH e1 AS (SELECT book_id, chapter_idx, CASE WHEN chapter_idx % 4 = 0 THEN {CAPS.format(BASE)} ELSE {BASE} END AS title FROM chapters WHERE chapter_idx % 5 > 0),
e2 AS (SELECT book_id, chapter_idx, CASE chapter_idx % 4 WHEN 1 THEN {CAPS.format(BASE)} WHEN 2 THEN {BASE} || ' again' ELSE {BASE} END AS title FROM chapters WHERE chapter_idx % 7 > 0)"""
LOUD = f"({{0}} = {CAPS} AND {{0}} <> translate({{0}}, '{CAPITALS}', '{SMALL_LETTERS}'))"
MATCH_SQL = f"CASE WHEN {LOUD.format('a.title')} AND NOT {LOUD.format('b.title')} THEN b.title WHEN {LOUD.format('b.title')} AND NOT {LOUD.format('a.title')} THEN a.title WHEN length(b.title) > length(a.title) THEN b.title ELSE a.title END"


def matched(a: Column, b: Column) -> Column:
    """Of two titles of one chapter the one that is not all capitals, else the longer, of equals the first."""
    loud = lambda c: (c == in_capitals(c)) & (c != F.translate(c, CAPITALS, SMALL_LETTERS))
    return F.when(loud(a) & ~loud(b), b).when(loud(b) & ~loud(a), a).when(F.length(b) > F.length(a), b).otherwise(a)


@query("p6_title_match", f"{EDITIONS} SELECT a.book_id, a.chapter_idx, {MATCH_SQL} AS title FROM e1 a JOIN e2 b USING (book_id, chapter_idx)")
def p6(fx: Fixtures) -> DataFrame:
    a, b = editions(fx)
    return a.join(b.withColumnRenamed("title", "other"), CHAPTER).select(*CHAPTER, matched(F.col("title"), F.col("other")).alias("title"))


@query("p7_unmatched_titles", f"{EDITIONS} SELECT 'left' AS side, book_id, chapter_idx FROM e1 ANTI JOIN e2 USING (book_id, chapter_idx) UNION ALL SELECT 'right', book_id, chapter_idx FROM e2 ANTI JOIN e1 USING (book_id, chapter_idx)")
def p7(fx: Fixtures) -> DataFrame:
    a, b = editions(fx)
    miss = lambda x, y, side: x.join(y, CHAPTER, "left_anti").select(F.lit(side).alias("side"), *CHAPTER)
    return miss(a, b, "left").unionByName(miss(b, a, "right"))


def resolved(source: DataFrame, target: DataFrame) -> DataFrame:
    """book_id, chapter_idx, title and resolved: titles of the source that the target has in another form, which the match prefers.

    Blocked on book and chapter, which a match asks for; the condition on the titles is part of the join.
    """
    other = target.withColumnRenamed("title", "resolved")
    new = source.join(target, [*CHAPTER, "title"], "left_anti")
    same = (new["book_id"] == other["book_id"]) & (new["chapter_idx"] == other["chapter_idx"])
    return new.join(other, same & (matched(new["title"], other["resolved"]) == other["resolved"])).select(new["book_id"], new["chapter_idx"], new["title"], "resolved")


def resolved_sql(a: str, b: str, match: str) -> str:
    return f"SELECT x.book_id, x.chapter_idx, x.title, y.title AS resolved FROM {a} x JOIN {b} y ON x.book_id = y.book_id AND x.chapter_idx = y.chapter_idx AND {match} = y.title WHERE NOT EXISTS (SELECT 1 FROM {b} z WHERE z.book_id = x.book_id AND z.chapter_idx = x.chapter_idx AND z.title = x.title)"


XY = MATCH_SQL.replace("a.title", "x.title").replace("b.title", "y.title")


@query("jn12_resolved_titles", f"{EDITIONS} SELECT 'left' AS side, * FROM ({resolved_sql('e1', 'e2', XY)}) UNION ALL SELECT 'right' AS side, * FROM ({resolved_sql('e2', 'e1', XY)})")
def jn12_resolved(fx: Fixtures) -> DataFrame:
    """Titles without an equal in the other edition, resolved both ways."""
    a, b = editions(fx)
    return resolved(a, b).withColumn("side", F.lit("left")).unionByName(resolved(b, a).withColumn("side", F.lit("right")))


BOOKS = """WITH p AS (SELECT chapter_idx, par_idx, regexp_replace(text, '\\s+$', '') AS line, row_number() OVER (PARTITION BY chapter_idx ORDER BY par_idx) AS n FROM par0 WHERE trim(text, chr(10) || chr(9) || chr(13) || ' ') <> '')"""


@query("p1_chapters_of_books", f"{BOOKS} SELECT chapter_idx, n - 1 AS pos, (n + 3) // 4 AS book_num, 'Part ' || ((n + 3) // 4) AS book_title, n AS number, CASE WHEN n % 2 = 0 THEN 'Of number ' || n END AS title, CAST(1 AS BIGINT) AS n_lines, md5(line) AS digest FROM p")
def p1(fx: Fixtures) -> DataFrame:
    """Books built of headed paragraphs (a section each four, every other chapter with a title) come apart into these again."""
    from spanloom.operators.chapter_split import split_books

    bare = F.filter(F.transform(F.split("original", "\n", -1), lambda p: F.regexp_replace(p, r"\s+$", "")), lambda p: p != "")

    def headed(p: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        section = F.when(i % 4 == 0, F.concat(F.lit("Book "), (i / 4 + 1).cast("int").cast("string"), F.lit(". Part "), (i / 4 + 1).cast("int").cast("string"), F.lit("\n"))).otherwise("")
        title = F.when((i + 1) % 2 == 0, F.concat(F.lit(". Of number "), n)).otherwise("\n-")
        return F.concat(section, F.lit("Chapter "), n, title, F.lit("\n"), p)

    books = fx.chapters.select("chapter_idx", F.concat(F.array_join(F.transform(bare, headed), "\n"), F.lit("\nThe End")).alias("text"))
    found = split_books(books, "chapter_idx")
    return found.select("chapter_idx", "pos", "book_num", "book_title", "number", "title", F.size("lines").cast("bigint").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


ABBREVIATED = ", ".join("'" + a + "'" for a in tx.ABBREVIATIONS)
JOINED = f"""WITH f AS (SELECT *, NOT coalesce(lower(list_last(string_split(regexp_replace(lag(text) OVER w, '\\s+$', ''), ' '))) IN ({ABBREVIATED}) OR regexp_matches(regexp_replace(text, '\\s+$', ''), '^[!-/:-@\\[-`{{-~]*$'), false)
  OR lag(seg_idx) OVER w IS NULL AS opens FROM segments WINDOW w AS (PARTITION BY chapter_idx, par_idx ORDER BY seg_idx)),
g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY chapter_idx ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) - 1 AS new_idx FROM f)"""


@query("seg1_repaired_segments", f"{JOINED} SELECT chapter_idx, CAST(new_idx AS BIGINT) AS seg_idx, min(par_idx) AS par_idx, string_agg(text, '' ORDER BY seg_idx) AS text FROM g GROUP BY chapter_idx, new_idx")
def seg1(fx: Fixtures) -> DataFrame:
    return repaired(fx)


def repaired(fx: Fixtures) -> DataFrame:
    """A segment joins the one before it in its paragraph if that ends in an abbreviation or it is punctuation only."""
    before = Window.partitionBy("chapter_idx", "par_idx").orderBy("seg_idx")
    joins = F.coalesce(tx.ends_in_abbreviation(F.lag("text").over(before)) | tx.only_punctuation(F.col("text")), F.lit(False))
    opens = ~joins | F.lag("seg_idx").over(before).isNull()
    numbered = fx.segments.withColumn("opens", opens).withColumn("new_idx", running(F.col("opens").cast("int"), "seg_idx") - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), "")
    return numbered.groupBy("chapter_idx", "new_idx").agg(F.min("par_idx").alias("par_idx"), text.alias("text")).withColumnRenamed("new_idx", "seg_idx")


@query("seg2_segment_edges", f"SELECT chapter_idx, seg_idx, lower(list_last(string_split(regexp_replace(text, '\\s+$', ''), ' '))) IN ({ABBREVIATED}) AS abbreviated, regexp_matches(regexp_replace(text, '\\s+$', ''), '^[!-/:-@\\[-`{{-~]*$') AS punctuation FROM segments")
def seg2(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", "seg_idx", tx.ends_in_abbreviation(F.col("text")).alias("abbreviated"), tx.only_punctuation(F.col("text")).alias("punctuation"))


@query("seg3_plain_segments", "SELECT chapter_idx, par_idx, count(*) AS n_segments FROM segments GROUP BY ALL")
def seg3(fx: Fixtures) -> DataFrame:
    return fx.paragraphs.select("chapter_idx", "par_idx", F.size(tx.sentence_texts(F.col("text"))).cast("bigint").alias("n_segments")).where("n_segments > 0")


@query("seg4_paragraph_numbers", "SELECT chapter_idx, seg_idx + 1 AS seg_num, par_idx + 1 AS paragraph_num FROM segments")
def seg4(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", (F.col("seg_idx") + 1).alias("seg_num"), (F.col("par_idx") + 1).alias("paragraph_num"))


@query("tok1_words", "SELECT doc_id AS chapter_idx, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_words FROM documents")
def tok1(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", F.size(tx.words(F.col("original"))).cast("bigint").alias("n_words"))


@query("tok2_tokens_with_blanks", r"SELECT doc_id AS chapter_idx, CAST(len(regexp_extract_all(text, '\s?[A-Za-z0-9]+|\s?[^A-Za-z0-9\s]')) AS BIGINT) AS n_tokens FROM documents")
def tok2(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", F.size(tx.tokens(F.col("original"))).cast("bigint").alias("n_tokens"))


TOKENS = r"""WITH t0 AS (SELECT chapter_idx, seg_idx, unnest(range(len(t))) AS k, unnest(t) AS token FROM (SELECT *, regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s?[A-Za-z0-9]+|\s?[^A-Za-z0-9\s]') AS t FROM segments)),
tk AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY chapter_idx, seg_idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM t0)"""


def placed(fx: Fixtures) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", "\\s+", " "))
    return fx.segments.select("chapter_idx", "seg_idx", F.posexplode(tx.tokens(clean)).alias("k", "token")).withColumn("stop", F.sum(F.length("token")).over(Window.partitionBy("chapter_idx", "seg_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))


@query("tok3_tokens_with_offsets", f"{TOKENS} SELECT chapter_idx, seg_idx, k, lower(ltrim(token)) AS token, stop - length(ltrim(token)) AS start_char, stop AS end_char FROM tk")
def tok3(fx: Fixtures) -> DataFrame:
    word = F.ltrim("token")
    return placed(fx).select("chapter_idx", "seg_idx", F.col("k").cast("bigint").alias("k"), F.lower(word).alias("token"), (F.col("stop") - F.length(word)).alias("start_char"), F.col("stop").alias("end_char"))


@query("tok4_right_trimmed", r"SELECT chapter_idx, seg_idx, CAST(length(CASE WHEN text LIKE '% ' THEN rtrim(text) ELSE text END) AS BIGINT) AS size FROM segments")
def tok4(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", "seg_idx", F.length(F.when(F.col("text").endswith(" "), F.rtrim("text")).otherwise(F.col("text"))).cast("bigint").alias("size"))


@query("tok5_joined_tokens", f"{TOKENS} SELECT chapter_idx, seg_idx, md5(string_agg(token, '' ORDER BY k)) AS digest FROM tk GROUP BY ALL")
def tok5(fx: Fixtures) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", "\\s+", " "))
    t = tx.tokens(clean)
    return fx.segments.where(F.size(t) > 0).select("chapter_idx", "seg_idx", F.md5(F.array_join(t, "")).alias("digest"))


ITEMS_SQL = "list_transform({0}_segments, lambda s, i: '[' || {0}_nums[i] || '] ' || s)"
CELL_SQL = f"CASE WHEN row % 2 = 0 THEN array_to_string({ITEMS_SQL}, chr(10)) ELSE array_to_string({ITEMS_SQL}, chr(9)) END"
NUMBERS_SQL = r"list_transform(regexp_extract_all({0}, '\[([0-9]+)\](.*)', 1), lambda x: CAST(x AS BIGINT))"


@query("val1_sheet_cells", f"WITH c AS (SELECT chapter_idx, row, {CELL_SQL.format('original')} AS o, {CELL_SQL.format('abridged')} AS a FROM grouped), n AS (SELECT chapter_idx, row, {NUMBERS_SQL.format('o')} AS original, {NUMBERS_SQL.format('a')} AS abridged FROM c) SELECT chapter_idx, row, array_to_string(original, ',') AS original, array_to_string(abridged, ',') AS abridged FROM n WHERE len(original) > 0 OR len(abridged) > 0")
def val1(fx: Fixtures) -> DataFrame:
    """Cells of review sheets, with a line for each segment or all in one: a number per line; rows without a number on either side go."""
    between = F.when(F.col("row") % 2 == 0, "\n").otherwise("\t")

    def cell(side: str) -> Column:
        items = F.transform(f"{side}_segments", lambda s, i: F.concat(F.lit("["), F.get(F.col(f"{side}_nums"), i).cast("string"), F.lit("] "), s))
        return F.reduce(items, F.lit(""), lambda text, x: F.concat(text, F.when(text == "", "").otherwise(between), x))

    read = fx.grouped.select("chapter_idx", "row", tx.first_numbers(cell("original")).alias("original"), tx.first_numbers(cell("abridged")).alias("abridged"))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return read.where((F.size("original") > 0) | (F.size("abridged") > 0)).select("chapter_idx", "row", listed("original"), listed("abridged"))


@query("pck1_restored_breaks", "SELECT chapter_idx, seg_idx, text || CASE WHEN lead(par_idx) OVER w <> par_idx THEN chr(10) ELSE '' END AS text FROM (SELECT chapter_idx, seg_idx, par_idx, rtrim(text, chr(10)) AS text FROM segments) WINDOW w AS (PARTITION BY chapter_idx ORDER BY seg_idx)")
def pck1(fx: Fixtures) -> DataFrame:
    bare = fx.segments.select("chapter_idx", "seg_idx", "par_idx", F.regexp_replace("text", "\n+$", "").alias("text"))
    ends = F.lead("par_idx").over(Window.partitionBy("chapter_idx").orderBy("seg_idx")) != F.col("par_idx")
    return bare.select("chapter_idx", "seg_idx", F.concat("text", F.when(ends, "\n").otherwise("")).alias("text"))


@query("pck2_spans_from_segments", "SELECT chapter_idx, row, min(start_char) AS o_start, max(end_char) AS o_end, min(a_start) AS a_start, max(a_end) AS a_end FROM (SELECT *, seg_idx // 2 AS row FROM rws) GROUP BY ALL")
def pck2(fx: Fixtures) -> DataFrame:
    rows = fx.rows.withColumn("row", F.floor(F.col("seg_idx") / 2).cast("bigint"))
    return rows.groupBy("chapter_idx", "row").agg(F.min("start_char").alias("o_start"), F.max("end_char").alias("o_end"), F.min("a_start").alias("a_start"), F.max("a_end").alias("a_end"))


@query("pck3_hash_split", f"SELECT book_id, chapter_idx, CASE WHEN r0 = 1 THEN 'dev' WHEN r <= 5 THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY book_id, r0 = 1 ORDER BY md5(CAST(chapter_idx AS VARCHAR))) AS r FROM (SELECT book_id, chapter_idx, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) AS r0 FROM chapters))")
def pck3(fx: Fixtures) -> DataFrame:
    """The first chapter is dev; of the others the first five in hash order are test. Only these few of a book meet, after a limit in each task."""
    keys = fx.chapters.select(*CHAPTER)
    dev = keys.groupBy("book_id").agg(F.min("chapter_idx").alias("dev"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.md5(F.col("chapter_idx").cast("string"))))
    early = keys.withColumn("place", place).where("place <= 6").join(dev, "book_id")
    others = F.count_if(F.col("chapter_idx") != F.col("dev")).over(Window.partitionBy("book_id").orderBy("place"))
    test = early.withColumn("others", others).where("chapter_idx <> dev AND others <= 5").select(*CHAPTER, F.lit("test").alias("split"))
    chosen = test.unionByName(dev.select("book_id", F.col("dev").alias("chapter_idx"), F.lit("dev").alias("split")))
    return keys.join(chosen, CHAPTER, "left").select(*CHAPTER, F.coalesce("split", F.lit("train")).alias("split"))


@query("pck4_tiling_holds", "SELECT chapter_idx, string_agg(s.text, '' ORDER BY seg_idx) = original AS ok FROM chapters JOIN segments s USING (chapter_idx) GROUP BY chapter_idx, original")
def pck4(fx: Fixtures) -> DataFrame:
    """Concatenated segments are the chapter's text."""
    joined = fx.segments.groupBy("chapter_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), "").alias("t"))
    return joined.join(fx.chapters.drop("book_id"), "chapter_idx").select("chapter_idx", (F.col("t") == F.col("original")).alias("ok"))


@query("pck5_numbers_complete", "SELECT chapter_idx, CAST(count(DISTINCT n) = max(n) AS BOOLEAN) AS complete FROM (SELECT chapter_idx, unnest(original_nums) AS n FROM grouped) GROUP BY ALL")
def pck5(fx: Fixtures) -> DataFrame:
    nums = fx.grouped.select("chapter_idx", F.explode("original_nums").alias("n"))
    step = nums.withColumn("new", F.coalesce(F.lag("n").over(Window.partitionBy("chapter_idx").orderBy("n")) != F.col("n"), F.lit(True)))
    return step.groupBy("chapter_idx").agg((F.count_if("new") == F.max("n")).alias("complete"))


@query("pck6_packed_digest", "SELECT chapter_idx, md5(original || '|' || abridged) AS digest FROM chapters JOIN versions USING (chapter_idx) WHERE rater = 17")
def pck6(fx: Fixtures) -> DataFrame:
    return fx.chapters.join(fx.abridged(17).drop("book_id"), "chapter_idx").select("chapter_idx", F.md5(F.concat("original", F.lit("|"), "abridged")).alias("digest"))


LABELS = r"""WITH lab AS (SELECT a.chapter_idx, a.seg_idx, a.book_id, unnest(regexp_extract_all(a.text, '\s?[A-Za-z0-9]+|\s?[^A-Za-z0-9\s]')) AS token, CAST(NOT a.kept AS INT) AS gold, CAST(NOT b.kept AS INT) AS predicted FROM rated a JOIN rated b USING (chapter_idx, seg_idx) WHERE a.rater = 17 AND b.rater = 19)"""


def labelled(fx: Fixtures) -> DataFrame:
    """chapter_idx, seg_idx, token, gold, predicted: 1 for tokens that are not kept"""
    both = fx.segments.select("book_id", "chapter_idx", "seg_idx", (~keeps(17)).cast("int").alias("gold"), (~keeps(19)).cast("int").alias("predicted"), "text")
    return both.select("book_id", "chapter_idx", "seg_idx", "gold", "predicted", F.explode(tx.tokens(F.col("text"))).alias("token"))


@query("lbl1_token_labels", f"{LABELS} SELECT chapter_idx, seg_idx, gold AS label, count(*) AS n_tokens FROM lab GROUP BY ALL")
def lbl1(fx: Fixtures) -> DataFrame:
    return labelled(fx).groupBy("chapter_idx", "seg_idx", F.col("gold").alias("label")).agg(F.count("*").alias("n_tokens"))


@query("lbl2_labels_by_chapter", f"{LABELS} SELECT book_id, chapter_idx, count(*) AS n_tokens, CAST(sum(gold) AS BIGINT) AS n_modified FROM lab GROUP BY ALL")
def lbl2(fx: Fixtures) -> DataFrame:
    return labelled(fx).groupBy(*CHAPTER).agg(F.count("*").alias("n_tokens"), F.sum("gold").alias("n_modified"))


@query("lbl3_padded_predictions", "SELECT chapter_idx, n, CAST(coalesce(s, 0) AS BIGINT) AS n_modified FROM (SELECT chapter_idx, count(*) AS n, sum(CAST(NOT kept AS INT)) FILTER (seg_idx < floor(c * 0.9)) AS s FROM (SELECT *, count(*) OVER (PARTITION BY chapter_idx) AS c FROM rws) GROUP BY ALL)")
def lbl3(fx: Fixtures) -> DataFrame:
    listed = fx.rows.groupBy("chapter_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", (~F.col("kept")).cast("int").alias("y")))), lambda s: s["y"]).alias("gold"))
    cut = F.slice("gold", 1, F.floor(F.size("gold") * 0.9).cast("int"))
    full = tx.padded_labels(F.col("gold"), cut)
    return listed.select("chapter_idx", F.size(full).cast("bigint").alias("n"), F.aggregate(full, F.lit(0).cast("bigint"), lambda a, y: a + y).alias("n_modified"))


@query("ext1_kept_tokens", f"{LABELS.replace('seg_idx, a.book_id, unnest', 'seg_idx, a.book_id, unnest(range(len(regexp_extract_all(a.text, chr(92) || chr(115) || $$?[A-Za-z0-9]+|$$ || chr(92) || chr(115) || $$?[^A-Za-z0-9$$ || chr(92) || $$s]$$)))) AS k, unnest')} SELECT chapter_idx, md5(string_agg(token, '' ORDER BY seg_idx, k)) AS digest FROM lab WHERE predicted = 0 GROUP BY ALL")
def ext1(fx: Fixtures) -> DataFrame:
    kept = fx.rated(19).where("kept").select("chapter_idx", "seg_idx", F.array_join(tx.tokens(F.col("text")), "").alias("t")).where("t <> ''")
    return kept.groupBy("chapter_idx").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "t"))), lambda s: s["t"]), "")).alias("digest"))


@query("ext2_segments_by_share", "WITH w AS (SELECT chapter_idx, seg_idx // 3 AS part, avg(CAST(kept AS INT)) AS share, string_agg(text, '' ORDER BY seg_idx) AS t FROM rated WHERE rater = 19 GROUP BY ALL) SELECT chapter_idx, count(*) AS n_parts, md5(string_agg(t, '' ORDER BY part)) AS digest FROM w WHERE share >= 0.5 GROUP BY ALL")
def ext2(fx: Fixtures) -> DataFrame:
    """Stretches are kept whole if at least half of what is in them is."""
    part = F.floor(F.col("seg_idx") / 3).cast("bigint").alias("part")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), "").alias("t")
    kept = fx.rated(19).groupBy("chapter_idx", part).agg(F.avg(F.col("kept").cast("int")).alias("share"), joined).where("share >= 0.5")
    return kept.groupBy("chapter_idx").agg(F.count("*").alias("n_parts"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda s: s["t"]), "")).alias("digest"))


@query("ext3_segments_of_tokens", f"{TOKENS}, e AS (SELECT *, coalesce(sum(CAST(ltrim(token) IN ('.', '?', '!', ':', ';') AS INT)) OVER (PARTITION BY chapter_idx, seg_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM tk) SELECT chapter_idx, seg_idx, CAST(part AS BIGINT) AS part, count(*) AS n_tokens FROM e GROUP BY ALL")
def ext3(fx: Fixtures) -> DataFrame:
    """A token segment ends with an end mark."""
    ends = F.ltrim("token").isin(".", "?", "!", ":", ";").cast("int")
    part = F.coalesce(F.sum(ends).over(Window.partitionBy("chapter_idx", "seg_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed(fx).withColumn("part", part.cast("bigint")).groupBy("chapter_idx", "seg_idx", "part").agg(F.count("*").alias("n_tokens"))


@query("ext4_chapter_extracts", "SELECT chapter_idx, trim(string_agg(trim(text), ' ' ORDER BY seg_idx)) AS extract FROM (SELECT chapter_idx, seg_idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM rated WHERE rater = 19 AND kept) GROUP BY ALL")
def ext4(fx: Fixtures) -> DataFrame:
    kept = fx.rated(19).where("kept").select("chapter_idx", "seg_idx", F.regexp_replace("text", "^\\s+|\\s+$", "").alias("t"))
    return kept.groupBy("chapter_idx").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "t"))), lambda s: s["t"]), " ")).alias("extract"))


@query("ext5_random_extracts", "SELECT chapter_idx, seg_idx FROM (SELECT chapter_idx, seg_idx, row_number() OVER (PARTITION BY chapter_idx ORDER BY md5(chapter_idx || ':' || seg_idx)) AS r, count(*) OVER (PARTITION BY chapter_idx) AS n FROM segments) WHERE r <= floor(n * 0.5)")
def ext5(fx: Fixtures) -> DataFrame:
    """A share of the sentences, drawn by hash order."""
    by = Window.partitionBy("chapter_idx")
    drawn = F.row_number().over(by.orderBy(F.md5(F.concat_ws(":", F.col("chapter_idx").cast("string"), F.col("seg_idx").cast("string")))))
    return fx.segments.select("chapter_idx", "seg_idx", drawn.alias("r"), F.count("*").over(by).alias("n")).where("r <= floor(n * 0.5)").select("chapter_idx", "seg_idx")


@query("win1_numbered_passages", "SELECT book_id, chapter_idx, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) - 1 AS idx FROM chapters")
def win1(fx: Fixtures) -> DataFrame:
    """Counts of blocks of chapter numbers give each block its first index, so no task holds a whole book."""
    blocks = fx.chapters.select(*CHAPTER, F.floor(F.col("chapter_idx") / 65536).alias("block"))
    upto = Window.partitionBy("book_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("book_id", "block").agg(F.count("*").alias("n"))
    first = sizes.select("book_id", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("book_id", "block").orderBy("chapter_idx")) - 1
    return blocks.join(first, ["book_id", "block"]).select(*CHAPTER, (F.col("before") + inside).cast("bigint").alias("idx"))


@query("win2_running_offsets", "SELECT chapter_idx, par_idx, end_char AS upto FROM paragraphs")
def win2(fx: Fixtures) -> DataFrame:
    return fx.paragraphs.select("chapter_idx", "par_idx", F.col("end_char").alias("upto"))


@query("win3_neighbours", "SELECT chapter_idx, seg_idx, lag(length(text)) OVER w AS before, lead(length(text)) OVER w AS after FROM segments WINDOW w AS (PARTITION BY chapter_idx ORDER BY seg_idx)")
def win3(fx: Fixtures) -> DataFrame:
    w = Window.partitionBy("chapter_idx").orderBy("seg_idx")
    size = F.length("text").cast("bigint")
    return fx.segments.select("chapter_idx", "seg_idx", F.lag(size).over(w).alias("before"), F.lead(size).over(w).alias("after"))


@query("win4_occurrence_ranks", "SELECT chapter_idx, seg_idx, row_number() OVER (PARTITION BY chapter_idx, text ORDER BY seg_idx) - 1 AS occurrence FROM segments")
def win4(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", "seg_idx", (F.row_number().over(Window.partitionBy("chapter_idx", "text").orderBy("seg_idx")) - 1).cast("bigint").alias("occurrence"))


@query("win5_longest_kept_run", "SELECT chapter_idx, max(n) AS longest FROM (SELECT chapter_idx, seg_idx - r AS island, count(*) AS n FROM (SELECT chapter_idx, seg_idx, row_number() OVER (PARTITION BY chapter_idx ORDER BY seg_idx) AS r FROM rws WHERE kept) GROUP BY ALL) GROUP BY ALL")
def win5(fx: Fixtures) -> DataFrame:
    island = (F.col("seg_idx") - F.row_number().over(Window.partitionBy("chapter_idx").orderBy("seg_idx"))).alias("island")
    return fx.rows.where("kept").select("chapter_idx", island).groupBy("chapter_idx", "island").agg(F.count("*").alias("n")).groupBy("chapter_idx").agg(F.max("n").alias("longest"))


@query("win6_forward_frames", "SELECT chapter_idx, seg_idx, CAST(sum(length(text)) OVER (PARTITION BY chapter_idx ORDER BY seg_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS BIGINT) AS size FROM segments")
def win6(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", "seg_idx", F.sum(F.length("text")).over(Window.partitionBy("chapter_idx").orderBy("seg_idx").rowsBetween(0, 3)).alias("size"))


@query("win7_filled_forward", "SELECT chapter_idx, seg_idx, last_value(CASE WHEN kept THEN seg_idx END IGNORE NULLS) OVER (PARTITION BY chapter_idx ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS last_kept FROM rws")
def win7(fx: Fixtures) -> DataFrame:
    w = Window.partitionBy("chapter_idx").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    return fx.rows.select("chapter_idx", "seg_idx", F.last(F.when(F.col("kept"), F.col("seg_idx")), ignorenulls=True).over(w).alias("last_kept"))


@query("srt1_overlaps_by_place", "SELECT chapter_idx, string_agg(CAST(o_start AS VARCHAR), ',' ORDER BY a_start, pos) AS starts FROM reordered GROUP BY ALL")
def srt1(fx: Fixtures) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("a_start", "pos", "o_start")))
    return fx.reordered.groupBy("chapter_idx").agg(F.array_join(F.transform(listed, lambda s: s["o_start"].cast("string")), ",").alias("starts"))


@query("lim1_first_longest_segment", "SELECT chapter_idx, arg_max(seg_idx, length(text) * 1000000 - seg_idx) AS seg_idx FROM segments GROUP BY ALL")
def lim1(fx: Fixtures) -> DataFrame:
    return fx.segments.groupBy("chapter_idx").agg(F.max_by("seg_idx", F.struct(F.length("text"), -F.col("seg_idx"))).alias("seg_idx"))


@query("lim2_first_of_hash_order", "SELECT book_id, chapter_idx FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY md5(CAST(chapter_idx AS VARCHAR))) AS r FROM chapters) WHERE r <= 3")
def lim2(fx: Fixtures) -> DataFrame:
    return fx.chapters.select(*CHAPTER, F.row_number().over(Window.partitionBy("book_id").orderBy(F.md5(F.col("chapter_idx").cast("string")))).alias("r")).where("r <= 3").drop("r")


@query("lim3_first_match", "SELECT chapter_idx, min(seg_idx) AS seg_idx FROM segments WHERE contains(text, ',') GROUP BY ALL")
def lim3(fx: Fixtures) -> DataFrame:
    return fx.segments.where(F.contains("text", F.lit(","))).groupBy("chapter_idx").agg(F.min("seg_idx").alias("seg_idx"))


def set_sql(kind: str) -> str:
    return f"SELECT chapter_idx, seg_idx FROM rated WHERE rater = 17 AND kept {kind} SELECT chapter_idx, seg_idx FROM rated WHERE rater = 19 AND kept"


def kept_by(fx: Fixtures, rater: int) -> DataFrame:
    return fx.rated(rater).where("kept").select("chapter_idx", "seg_idx")


@query("set1_kept_by_both", set_sql("INTERSECT"))
def set1(fx: Fixtures) -> DataFrame:
    return kept_by(fx, 17).intersect(kept_by(fx, 19))


@query("set2_kept_by_one", set_sql("EXCEPT"))
def set2(fx: Fixtures) -> DataFrame:
    return kept_by(fx, 17).subtract(kept_by(fx, 19))


@query("set3_kept_by_any", set_sql("UNION"))
def set3(fx: Fixtures) -> DataFrame:
    return kept_by(fx, 17).union(kept_by(fx, 19)).distinct()


@query("set4_equal_keys", "SELECT (SELECT count(*) FROM (SELECT DISTINCT chapter_idx FROM chapters EXCEPT SELECT chapter_idx FROM segments)) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT chapter_idx FROM segments EXCEPT SELECT chapter_idx FROM chapters)) = 0 AS equal")
def set4(fx: Fixtures) -> DataFrame:
    a, b = fx.chapters.select("chapter_idx").distinct(), fx.segments.select("chapter_idx").distinct()
    left = a.exceptAll(b).unionByName(b.exceptAll(a))
    return left.agg((F.count("*") == 0).alias("equal"))
