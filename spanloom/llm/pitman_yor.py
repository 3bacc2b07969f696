"""LM scoring with a hierarchical Pitman-Yor model: a restaurant for each context, all sharing one parent.

A word's context is the word before it (or the text's beginning), hashed to restaurants whose number grows with the
input up to `most_contexts`; beyond that, contexts that meet in one restaurant share its counts (README: what this
costs). Their common parent is the unigram restaurant, whose base is uniform over the V training words and one unknown.
Everything about a word, in every context, lies in the bucket of that word's hash, so seating is local;
restaurants know each other only by their totals, one number per context (a table of bounded size, passed by broadcast).

Seating is kept as table sizes and sampled by Gibbs (seating.py): customers leave their tables and are seated again given
where the others of their dish sit, in each sweep all of them. At first each dish has one table. `burn_in` rounds of one sweep are followed by one
of `samples` sweeps, each with the totals and the parent's probabilities of the round before; the contexts' tables are
the parent's customers, and it seats those that came, lets go those that left, and is swept itself. Seats are
written after each round, no sweep is done twice. A token's probability is the mean of its predictive
probabilities over the samples. Discounts come from the counts of ones and twos.

Tokens travel packed, twice: counted for training, by document for scoring. A bucket with far more tokens than others (a
very frequent word) is scored in several parts by document. Only sums by document come back.

Defined cases: null and empty texts are one end token; rows that share a key are told apart by 64-bit hashes of their texts, equal
rows get equal results; null keys are held as one key; other columns are ignored; an empty table gives no
rows; without training text every word is unknown and all probabilities are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import packing
from spanloom.llm.arrays import LOWER, U64, buffers, mix, slices, span_hashes, words
from spanloom.llm.runtime import buckets_for, discard, let_go, small_batches, small_reads, written
from spanloom.llm.seating import adjusted, swept
from spanloom.llm.substrings import keyed_documents, measured

#: The end of a text, as a word hash, and the hash that stands before a text.
END, BEGIN = U64(0x9C1F0D5A7B3E2468), U64(0x35A1C7E94B0D8F26)
#: Tokens that are packed or scored at a time.
FLUSH = 1 << 19
#: Partial sums of logarithms travel as whole multiples of this.
UNIT = 1e-9
#: Totals by context travel in so many parts, and of so many buckets meet at once.
PARTS, SUMMED = 16, 256


def table_of(names: list[str]) -> tuple[pa.Schema, str]:
    """bucket, n, m and binary columns: as an Arrow schema and in SQL."""
    return pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), *((c, pa.binary()) for c in names)]), "bucket int, n int, m int, " + ", ".join(f"{c} binary" for c in names)


#: n entries of m words; runs: entries per word. Tokens: the place of each one's document among the row's documents (keys, tags).
COUNTS, COUNTS_SQL = table_of(["words", "runs", "contexts", "counts"])
_TOKENS = ["words", "runs", "contexts", "places", "keys", "tags"]
#: d: documents.
TOKENS_OF_DOCUMENTS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("d", pa.int32()), *((c, pa.binary()) for c in _TOKENS)])
TOKENS_OF_DOCUMENTS_SQL = "bucket int, n int, m int, d int, " + ", ".join(f"{c} binary" for c in _TOKENS)
#: Counts and seats (until the last round): table sizes of the entries and of the parent; then for each sample tables by entry and word. Totals (bucket below 0) use words, runs, contexts.
STATE, STATE_SQL = table_of(["words", "runs", "contexts", "counts", "tables", "sizes", "above", "samples"])
SUMS, SUMS_SQL = table_of(["keys", "tags", "a", "b", "c", "d"])


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a slice (words and one end per row), the token before each, and each token's row."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    h = span_hashes(raw, starts, ends, 60)
    rows = len(offsets) - 1
    token = np.empty(len(h) + rows, U64)
    ends_at = first[1:] + np.arange(rows)
    is_end = np.zeros(len(token), bool)
    is_end[ends_at] = True
    token[is_end], token[~is_end] = END, h
    before = np.empty(len(token), U64)
    before[1:] = token[:-1]
    before[np.concatenate([[0], ends_at[:-1] + 1])[:rows]] = BEGIN
    return token, before, np.repeat(np.arange(rows), np.diff(first) + 1)


def bucket_of(word: np.ndarray, n: int) -> np.ndarray:
    """Ranges of word hashes, so that words in order are in order of their buckets."""
    return ((word >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def by_pair(word: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by word and context, and where each word's entries begin in it."""
    order = np.argsort(word)
    ordered = word[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    order = order[np.argsort((np.cumsum(new) - 1) * contexts + context[order])]
    return order, np.flatnonzero(new)


def pack_all(*parts: np.ndarray) -> bytes:
    """Whole numbers whose count is stored with them."""
    a = np.concatenate(parts)
    return len(a).to_bytes(8, "little") + packing.pack_plain(a)


def unpack_all(b: bytes) -> np.ndarray:
    return packing.unpack_plain(b[8:], int.from_bytes(b[:8], "little"))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where entries in order differ from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def packed(schema: pa.Schema, rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def pack_pairs(word: np.ndarray, runs: np.ndarray, context: np.ndarray, first: np.ndarray) -> list[bytes]:
    """words, runs, contexts of entries in order of word and context, by what is short for each: hashes ascend, runs are small, contexts ascend within a word."""
    return [packing.pack_ints(word), packing.pack_plain(runs), packing.pack_runs(context, first)]


def unpack_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, runs, contexts and where each word's entries begin."""
    n, m = row["n"], row["m"]
    runs = packing.unpack_plain(row["runs"], m)
    first = np.cumsum(runs) - runs
    return packing.unpack_ints(row["words"], m).view(U64), runs, packing.unpack_runs(row["contexts"], first, n), first


def dealt(word: np.ndarray, context: np.ndarray, n_buckets: int, *more: np.ndarray) -> Iterator[tuple[int, np.ndarray, list]]:
    """Entries in order of word and context by bucket: its number, slice, and n, m, words, runs, contexts and the other columns packed."""
    first = starts_of(word)
    bucket = bucket_of(word[first], n_buckets)
    at = starts_of(bucket)
    edges, lasts = np.append(first, len(word)), np.append(at[1:], len(bucket))
    for a, b in zip(at.tolist(), lasts.tolist(), strict=True):
        cut = slice(int(edges[a]), int(edges[b]))
        row = [cut.stop - cut.start, b - a, *pack_pairs(word[edges[a:b]], np.diff(edges[a : b + 1]), context[cut], edges[a:b] - cut.start)]
        yield int(bucket[a]), cut, row + [packing.pack_plain(x[cut]) for x in more]


class Bucket:
    """Words of one bucket: their counts by context, in order, and where they sit."""

    def __init__(self, row: dict | None = None, word: np.ndarray | None = None, context: np.ndarray | None = None, count: np.ndarray | None = None):
        if row is not None:
            self.words, _, self.context, self.first = unpack_pairs(row)
            self.count = packing.unpack_plain(row["counts"], row["n"])
        else:
            self.first = starts_of(word)
            self.words, self.context, self.count = word[self.first], context, count
        self.which = np.repeat(np.arange(len(self.words)), np.diff(self.first, append=len(self.context)))

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first) if len(x) else x


def sparse_totals(contexts: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[list]:
    """Rows of totals by part of the contexts (the sums of other things stand behind these)."""
    part = np.minimum(at * PARTS // contexts, PARTS - 1)
    for p in np.unique(part).tolist():
        x = part == p
        yield [-1 - p, int(x.sum()), 0, packing.pack_ints(at[x]), packing.pack_plain(a[x]), packing.pack_plain(b[x])]


def totals(state: DataFrame, contexts: int, others: int, n_buckets: int, kinds: int = 1) -> list[np.ndarray]:
    """For each kind the sums over all buckets: two numbers per context and others. PARTS rows a kind come to the driver.

    Sums of at most about SUMMED buckets meet in a group, sums of these in further rounds, so that no group grows with the input.
    """

    def add(table: pa.Table) -> pa.Table:
        unpack = {"words": packing.unpack_ints, "runs": packing.unpack_plain, "contexts": packing.unpack_plain}
        at, a, b = (np.concatenate([of(x, n) for x, n in zip(table.column(c).to_pylist(), table.column("n").to_pylist(), strict=True)]) for c, of in unpack.items())
        where, spot = np.unique(at, return_inverse=True)
        sums = [np.bincount(spot, x).astype(np.int64) for x in (a, b)]
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([len(where)], pa.int32()), *(pa.array([x], pa.binary()) for x in (packing.pack_ints(where), *map(packing.pack_plain, sums)))], names)

    names, kind = ["bucket", "n", "words", "runs", "contexts"], "bucket int, n int, words binary, runs binary, contexts binary"
    out, rows = np.zeros((kinds, 2, contexts + others)), state.where("bucket < 0").select(*names)
    while n_buckets > SUMMED:
        n_buckets = -(-n_buckets // SUMMED)
        rows = rows.groupBy("bucket", F.pmod(F.xxhash64("words", "runs", "contexts"), F.lit(n_buckets)).alias("deal")).applyInArrow(add, kind)
    for r in rows.groupBy("bucket").applyInArrow(add, kind).collect():
        out[(-1 - r["bucket"]) // PARTS][:, packing.unpack_ints(r["words"], r["n"])] = packing.unpack_plain(r["runs"], r["n"]), packing.unpack_plain(r["contexts"], r["n"])
    return list(out)


def contexts_for(total_bytes: int, most: int) -> int:
    """Restaurants: a power of two, about one for each 32 bytes of text, 2^16 to `most`."""
    return min(most, 1 << max(16, (total_bytes >> 5).bit_length()))


def above(model: dict, top: tuple, send: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The parent's probabilities of words with these customers and tables; top: its totals of both."""
    rest = (model["strength0"] + model["discount0"] * top[1]) / (model["strength0"] + top[0])
    return np.maximum(send - model["discount0"] * tables, 0) / (model["strength0"] + top[0]) + rest / (model["V"] + 1)


def scores(docs: DataFrame, trains: Column, most_contexts: int = 1 << 20, burn_in: int = 1, samples: int = 3, strength: float = 5.0, strength0: float = 5.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row. trains: a condition on doc_id (null: false)."""
    spark = docs.sparkSession
    small_batches(spark)
    small_reads(spark)
    total, mixed = measured(docs)  # tags cost bytes: they are only sent if some key stands on different texts
    n_buckets, n_homes, contexts = buckets_for(spark, total, 8 << 20), buckets_for(spark, total, 96 << 20), contexts_for(total, most_contexts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = keyed_documents(docs, mixed).withColumn("trains", F.coalesce(trains, F.lit(False)))

    def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, before, row = token_hashes(raw, offsets)
        return mix(token), (mix(before) & U64(contexts - 1)).astype(np.int64), row

    def train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            word, context = (np.concatenate(x) for x in zip(*held, strict=True))
            order, _ = by_pair(word, context, contexts)
            word, context = word[order], context[order]
            at = starts_of(word, context)
            return packed(COUNTS, [[b, *row] for b, _, row in dealt(word[at], context[at], n_buckets, np.diff(at, append=len(word)))])

        for b in batches:
            raw, offsets = buffers(b.column(0))
            for _, _, cut, cut_offsets in slices(raw, offsets):
                held.append(tokens_of(cut, cut_offsets)[:2])
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield flush()
                    held = []
        if held:
            yield flush()

    def gather(table: pa.Table) -> pa.Table:
        """One bucket's counts, each entry with one table, and its totals."""
        rows = [Bucket(r) for r in table.to_pylist()]
        word, context, count = (np.concatenate(x) for x in zip(*((b.words[b.which], b.context, b.count) for b in rows), strict=True))
        order, _ = by_pair(word, context, contexts)
        word, context, count = word[order], context[order], count[order]
        at = starts_of(word, context)
        b = Bucket(None, word[at], context[at], np.add.reduceat(count, at))
        pairs, total = b.by_word(np.ones(len(b.context), np.int64)), b.by_word(b.count)
        own = [table.column("bucket")[0].as_py(), len(b.context), len(b.words), *pack_pairs(b.words, pairs, b.context, b.first), packing.pack_plain(b.count)]
        others = [len(b.words), (b.count == 1).sum(), (b.count == 2).sum()], [total.sum(), (pairs == 1).sum(), (pairs == 2).sum()]
        where = np.unique(b.context)
        sums = (np.bincount(np.searchsorted(where, b.context), x).astype(np.int64) for x in (b.count, None))
        tail = np.arange(contexts, contexts + 3)
        more = sparse_totals(contexts, *(np.concatenate(x) for x in zip((where, *sums), (tail, *others), strict=True)))
        one = np.ones(len(b.context), np.int64)
        seats = [pack_all(one), pack_all(b.count), pack_all(np.ones_like(pairs), pairs), b""]
        return pa.Table.from_batches([packed(STATE, [own + seats, *(r + [b""] * 5 for r in more)])])

    state = written(keyed.where("trains").select("text").mapInArrow(train_counts, COUNTS_SQL).groupBy("bucket").applyInArrow(gather, STATE_SQL), large=True)
    let_go(spark)
    ((customers, tables),) = totals(state, contexts, 3, n_buckets)
    vocabulary, ones, twos = customers[contexts:]
    n_train, ones0, twos0 = tables[contexts:]
    rate = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
    model = {"V": vocabulary, "N": n_train, "strength": strength, "strength0": strength0, "discount": rate(ones, twos), "discount0": rate(ones0, twos0), "customers": customers[:contexts].astype(np.float32)}
    now, found = (tables[:contexts].astype(np.float32), (tables[:contexts].sum(), vocabulary)), []

    def one_round(shared, number: int, sweeps: int):
        """Sweeps of all buckets with the totals that are shared."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, (sums, top) = shared.value
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {c: batch.column(c)[r].as_py() for c in STATE.names}
                    b, rng = Bucket(row), np.random.default_rng([row["bucket"], number, 17])
                    t, size, upper = unpack_all(row["tables"]), unpack_all(row["sizes"]), unpack_all(row["above"])
                    t0, size0, send = upper[: row["m"]], upper[row["m"] :], b.by_word(t)
                    weight = (m["strength"] + m["discount"] * sums[b.context]) * above(m, top, send, t0)[b.which]
                    weight0 = np.full(row["m"], (m["strength0"] + m["discount0"] * top[1]) / (m["V"] + 1))
                    where, spot = np.unique(b.context, return_inverse=True)
                    kept, out = [], []
                    for s in range(sweeps):
                        t, size = swept(b.count, t, size, weight, m["discount"], rng)
                        send, before = b.by_word(t), send
                        t0, size0 = swept(send, *adjusted(before, t0, size0, send, rng), weight0, m["discount0"], rng)
                        kept += [t, t0]
                        tail = [send.sum()], [t0.sum()]
                        sent = np.bincount(spot, t).astype(np.int64)
                        out += [[x[0] - PARTS * s, *x[1:]] for x in sparse_totals(contexts, np.append(where, contexts), np.append(sent, tail[0]), np.append(np.zeros_like(sent), tail[1]))]
                    # the last round's seats are not swept again, and only its samples are read
                    seats = [b"", b"", b"", pack_all(*kept)] if number == burn_in else [pack_all(t), pack_all(size), pack_all(t0, size0), b""]
                    yield packed(STATE, [[row[c] for c in STATE.names[:7]] + seats, *(x + [b""] * 5 for x in out)])

        return run

    for number in range(burn_in + 1):
        sweeps = samples if number == burn_in else 1
        shared = spark.sparkContext.broadcast((model, now))
        state, old = written(state.where("bucket >= 0").mapInArrow(one_round(shared, number, sweeps), STATE_SQL), large=True), state
        discard(old)
        found = [(x[0, :contexts].astype(np.float32), (x[0, contexts], x[1, contexts])) for x in totals(state, contexts, 1, n_buckets, sweeps)]
        now = found[-1]
    learned, summary = state.where("bucket >= 0").select("bucket", "n", "m", "words", "runs", "contexts", "counts", "samples"), (model, found)
    # a bucket with far more tokens than others is scored in parts, by document
    size = state.where("bucket >= 0").select("bucket", "n", "counts").mapInArrow(bucket_sizes, "bucket int, size bigint")
    most = max(4 * total // n_buckets // 6, 1 << 20)
    parts = {r["bucket"]: -(-r["size"] // most) for r in size.where(F.col("size") > most).collect()}  # at most total / most rows
    extra, upto = {}, n_buckets
    for bucket, p in sorted(parts.items()):
        extra[bucket], upto = (upto, p - 1), upto + p - 1
    shared = spark.sparkContext.broadcast(summary)

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        turn = 0

        def flush() -> pa.RecordBatch:
            word, context, keys, tags, place = (np.concatenate(x) for x in zip(*held, strict=True))
            docs_at = starts_of(place)
            place = np.repeat(np.arange(len(docs_at)), np.diff(docs_at, append=len(place)))
            keys, tags = packing.pack_ints(keys[docs_at]), packing.pack_ints(tags[docs_at])
            order, _ = by_pair(word, context, contexts)
            rows = []
            for b, _, row in dealt(word[order], context[order], n_buckets, place[order]):
                if b in extra and (piece := turn % (extra[b][1] + 1)):
                    b = extra[b][0] + piece - 1
                rows.append([b, *row, keys, tags])
            return packed(TOKENS_OF_DOCUMENTS, [[*r[:3], len(docs_at), *r[3:]] for r in rows])

        seen = 0
        for b in batches:
            keys, tags = np.asarray(b.column(0)), np.asarray(b.column(2))
            raw, offsets = buffers(b.column(1))
            for i, j, cut, cut_offsets in slices(raw, offsets):
                word, context, row = tokens_of(cut, cut_offsets)
                held.append((word, context, keys[i + row], tags[i + row], seen + row))
                seen += j - i
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield flush()
                    held, turn = [], turn + 1
        if held:
            yield flush()

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What was learned of a bucket, once for each part in which it is scored."""
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                yield one
                base, n = extra.get(one.column(0)[0].as_py(), (0, 0))
                for p in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([base + p], pa.int32()), *one.columns[1:]], schema=one.schema)

    def predict(learned: pa.Table, tokens: pa.Table) -> pa.Table:
        m, samples = shared.value
        none = np.zeros(0, np.int64)
        b = Bucket(learned.to_pylist()[0]) if learned.num_rows else Bucket(None, none.astype(U64), none, none)
        seats = unpack_all(learned.column("samples")[0].as_py()).reshape(len(samples), -1) if learned.num_rows else np.zeros((len(samples), 0), np.int64)
        total, size = b.by_word(b.count), len(b.context)
        unknown = [(m["strength0"] + m["discount0"] * top[1]) / (m["strength0"] + top[0]) / (m["V"] + 1) for _, top in samples]
        # the last row is that of words never seen
        parents = [np.append(above(m, top, b.by_word(x[:size]), x[size:]), u) for x, (_, top), u in zip(seats, samples, unknown, strict=True)]

        def open_table(spot: np.ndarray, context: np.ndarray) -> np.ndarray:
            return sum((m["strength"] + m["discount"] * sums[context].astype(np.float64)) * p[spot] for (sums, _), p in zip(samples, parents, strict=True)) / len(samples)

        below = m["strength"] + m["customers"].astype(np.float64)
        known_pair = np.log10((open_table(b.which, b.context) + b.count - m["discount"] * seats[:, :size].mean(axis=0)) / below[b.context])
        pair = b.which * contexts + b.context
        out: list[list[np.ndarray]] = []
        for r in range(tokens.num_rows):
            row = {c: tokens.column(c)[r].as_py() for c in TOKENS_OF_DOCUMENTS.names}
            n, (words_, runs, context, _) = row["n"], unpack_pairs(row)
            place = packing.unpack_plain(row["places"], n)
            spot = np.searchsorted(b.words, words_)
            known = np.append(b.words, U64(0))[spot] == words_
            known &= spot < len(b.words)
            spot[~known] = len(b.words)
            base = np.log10((np.append(total, 0)[spot] + 1) / (m["N"] + m["V"] + 1))
            spot, known, base = np.repeat(spot, runs), np.repeat(known, runs), np.repeat(base, runs)
            asked = spot * contexts + context
            at = np.searchsorted(pair, asked)
            seen = np.append(pair, -1)[at] == asked
            log = np.empty(n)
            log[seen] = known_pair[at[seen]]
            rest = ~seen
            log[rest] = np.log10(open_table(spot[rest], context[rest]) / below[context[rest]])
            d = row["d"]
            sums = [np.round(np.bincount(place, x, d) / UNIT).astype(np.int64) for x in (log, base)] + [np.bincount(place, x, d).astype(np.int64) for x in (known, None)]
            here = np.flatnonzero(sums[3])
            out.append([packing.unpack_ints(row[c], d)[here] for c in ("keys", "tags")] + [x[here] for x in sums])
        if not out:
            return SUMS.empty_table()
        key, tag, *values = (np.concatenate(x) for x in zip(*out, strict=True))
        key, tag, *values = added(key, tag, values)
        return sums_home(n_homes, key, tag, values)

    def assemble(rows: pa.Table, notes: pa.Table) -> pa.Table:
        keys, tags = np.asarray(rows.column("k")), np.asarray(rows.column("tag"))
        given = sums_of(notes)
        key, tag, *sums = added(given[0], given[1], given[2:])
        names, spot = np.unique(np.stack([np.append(key, keys), np.append(tag, tags)]), axis=1, return_inverse=True)
        mine, copies_of = spot[len(key) :], np.bincount(spot[len(key) :], minlength=names.shape[1])
        totals_of = [np.zeros(names.shape[1]) for _ in sums]
        for x, s in zip(totals_of, sums, strict=True):
            x[spot[: len(key)]] = s
        log, base, n_known, n = (x[mine] / copies_of[mine] for x in totals_of)
        whole = lambda x: pa.array(np.round(x).astype(np.int64))
        return pa.table([rows.column("doc_id"), whole(n), whole(n_known), pa.array(np.full(len(mine), int(n_train))), pa.array(base * UNIT), pa.array(log * UNIT)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packing.home_of(np.asarray(b.column(0)), n_homes)), *b.columns], ["bucket", "k", "doc_id", "tag"])

    tokens = keyed.select("k", "text", "tag").mapInArrow(all_tokens, TOKENS_OF_DOCUMENTS_SQL)
    ready = learned.mapInArrow(copies, "bucket int, n int, m int, words binary, runs binary, contexts binary, counts binary, samples binary")
    sums = ready.groupBy("bucket").cogroup(tokens.groupBy("bucket")).applyInArrow(predict, SUMS_SQL)
    rows = keyed.select("k", "doc_id", "tag").mapInArrow(homes, f"bucket int, k bigint, doc_id {kind}, tag bigint")
    return rows.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(assemble, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [int(packing.unpack_plain(c, n).sum()) for c, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["bucket", "size"])


def added(key: np.ndarray, tag: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums by (key, tag), in order: keys, tags, sums."""
    order = np.lexsort((tag, key))
    key, tag = key[order], tag[order]
    at = starts_of(key, tag)
    return [key[at], tag[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in values)]


def sums_home(n: int, key: np.ndarray, tag: np.ndarray, values: list[np.ndarray]) -> pa.Table:
    """Whole-number sums by document, packed for the documents' buckets."""
    home = packing.home_of(key, n)
    order = np.lexsort((tag, key, home))
    home = home[order]
    at = starts_of(home)
    rows = [[int(home[a]), int(b - a), 0, *(packing.pack_ints(x[order[a:b]]) for x in (key, tag)), *(packing.pack_plain(x[order[a:b]]) for x in values)] for a, b in zip(at, np.append(at[1:], len(home)), strict=True)]
    return pa.Table.from_batches([packed(SUMS, rows)])


def sums_of(table: pa.Table) -> list[np.ndarray]:
    n = table.column("n").to_pylist()
    out = []
    for c in SUMS.names[3:]:
        unpack = packing.unpack_ints if c in ("keys", "tags") else packing.unpack_plain
        parts = [unpack(x, k) for x, k in zip(table.column(c).to_pylist(), n, strict=True)]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out
