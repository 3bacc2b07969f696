"""Benchmark decontamination: CGK random-walk embedding, repeated bit sampling to a target recall, exact edit verification.

Words are runs between blanks and ASCII punctuation with A-Z lower-cased. A document holds an item of n words
if some stretch of it is within floor(n / 5) word edits (insertions, deletions, replacements) of the item.

1. Count filter, lossless: d edits leave at least n - q + 1 - q d of an item's q-grams, so only where a
   stretch of n + d words holds that many of them can it match (q = 3, less for items under 6 words).
2. The item-sized windows there are embedded by a CGK walk: at each step the walker reads a word and moves on or stays by
   a random function of step and word, so edit distance becomes Hamming distance. Each repeat takes a new walk and one
   sampled step of it; a document and an item are a candidate pair once any of their windows reads the item's word there.
   The number of repeats follows from the item's length: for each class of lengths, pairs at the largest distance are
   simulated (deletions, insertions, replacements, all three), and repeats are added until the expected share of pairs
   found by their one window at the right start is `recall`; other windows of a pair only add to that. Where no
   number of repeats up to MOST_REPEATS gives it, all pairs of the class are candidates.
3. Of candidate pairs the edit distance (free end) of every stretch that passed the count filter is computed exactly, so
   a found pair's distance and place are exact.
4. Pairs that no walk met but that passed the count filter are verified in the same way, so none within the distance is
   lost. Where only the document matters, this is left out for those that hold an item already.

Items go to the workers by broadcast, at most `item_bytes` of text at a time; a larger benchmark takes several
passes. Documents take one narrow pass, whatever the skew.

Defined cases: null and empty texts and items without words match nothing; equal items each match; repeated
document rows repeat their matches; null ids are allowed; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrays import LOWER, PUNCTUATION, U64, buffers, mix, rows_of, run_hashes, slices, span_hashes, stream, whole, words
from spanloom.llm.runtime import annotated, fresh, small_batches

END = U64(0)  # stands behind a stretch's last word
#: Expected share of item occurrences, at the largest distance, that the sampled steps find; the exact check finds the others.
RECALL = 0.999
MOST_STEPS, MOST_REPEATS = 256, 512


def edits_of(n: int) -> int:
    return n // 5


def gram_of(n: int) -> int:
    """The longest q up to 3 of which n // 5 edits must leave one."""
    return next((q for q in (3, 2, 1) if n - q + 1 - q * edits_of(n) >= 1), 1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets, PUNCTUATION)
    return span_hashes(raw, starts, ends) | U64(1), first


def rectangles(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Stretches of words as rows, END behind each."""
    if not len(h):
        return np.full((len(starts), width), END)
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    return np.where(inside, h[np.minimum(at, len(h) - 1)], END)


def edit_distances(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number of word edits from each item to a beginning of the stretch beside it, and that beginning's length."""
    columns = np.arange(texts.shape[1] + 1)
    row = np.broadcast_to(columns, (len(items), len(columns))).astype(np.int32)
    best, length = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    beyond = columns > sizes[:, None]
    for i in range(1, items.shape[1] + 1):
        change = np.empty_like(row)
        change[:, 0] = i
        change[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != items[:, i - 1 : i]))
        row = np.minimum.accumulate(change - columns, axis=1) + columns
        if (now := lengths == i).any():
            ended = np.where(beyond[now], 1 << 30, row[now])
            length[now] = ended.argmin(axis=1)
            best[now] = ended.min(axis=1)
    return best, length


def steps_of(n: int) -> int:
    """Steps among which one is sampled: twice the words, so that the walk gets about to their end."""
    return max(1, min(2 * n, MOST_STEPS))


def walk(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int, steps: int, each: bool = False) -> np.ndarray:
    """What CGK walkers over stretches of words read at the last of so many steps, or at each; all move on by the same random bits of (step, word)."""
    coins, at, out = stream(seed, steps), np.zeros(len(starts), np.int64), []
    for t in range(steps):
        read = h[starts + np.minimum(at, sizes - 1)]
        read[at >= sizes] = END
        if each:
            out.append(read)
        at += (mix(read ^ coins[t]) & U64(1)).astype(np.int64)
    return np.array(out) if each else read


def sampled(c: int, r: int, longest: int) -> tuple[int, int]:
    """Seed of the walk and number of steps up to the sampled one, of a repeat for a class of lengths."""
    return 500 + 1000 * c + r, 1 + int(stream(90_000 + 1000 * c + r, 1)[0] % U64(steps_of(longest)))


def edited(n: int, kind: int, rng: np.random.Generator) -> list[int]:
    """An item of words 1 to n after its largest number of edits of a kind, with other words behind."""
    text, fresh_ = list(range(1, n + 1)), n + 1
    for k in range(edits_of(n)):
        p, way = int(rng.integers(len(text))), kind if kind < 3 else k % 3
        text[p : p + 1] = [[], [text[p], fresh_], [fresh_]][way]
        fresh_ += 1
    return (text + list(range(fresh_, fresh_ + n)))[:n]


@lru_cache(None)
def repeats_of(c: int, recall: float, pairs: int = 128, walks: int = 8) -> int:
    """Repeats for items of over 2^(c-1) and up to 2^c words; 0 if MOST_REPEATS do not reach the recall."""
    low, high = min((1 << c >> 1) + 1, MOST_STEPS), min(1 << c, MOST_STEPS)
    fives = [n for n in range(low, high + 1) if n % 5 == 0]  # the most edits a word
    need = 1
    for n in {fives[0], fives[-1]} if fives else set():
        rng = np.random.default_rng(n)
        texts = np.array([edited(n, kind, rng) for kind in range(4) for _ in range(pairs)], U64)
        own = np.arange(len(texts), dtype=U64)[:, None] << U64(32)  # each pair has words of its own
        h = mix(np.concatenate([own + np.arange(1, n + 1, dtype=U64), own + texts])) | U64(1)
        starts, sizes = np.arange(len(h)) * n, np.full(len(h), n)
        same = np.zeros(len(texts))
        for w in range(walks):
            read = walk(h.ravel(), starts, sizes, 7_000 + w, steps_of(n), each=True)
            same += ((read[:, : len(texts)] == read[:, len(texts) :]) & (read[:, : len(texts)] != END)).mean(axis=0)
        apart = (1 - same / walks).reshape(4, pairs)
        enough = [t for t in range(1, MOST_REPEATS + 1) if ((apart**t).mean(axis=1) <= 1 - recall).all()]
        if not enough:
            return 0
        need = max(need, enough[0])
    return need


def classes(n: np.ndarray) -> np.ndarray:
    """Items and stretches are padded to their class of lengths, not to the longest; repeats go by class too."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


class Items:
    """The benchmark's words and q-grams, and what its walkers read at the sampled steps. repeats: those of each class, if known."""

    def __init__(self, ids: list[int], texts: list[str], recall: float = RECALL, repeats: dict[int, int] | None = None):
        raw, offsets = buffers(pa.array(texts, pa.string()))
        self.h, first = word_hashes(raw, offsets)
        self.ids, self.start, self.n = np.array(ids), first[:-1], np.diff(first)
        self.d, self.q = self.n // 5, np.array([gram_of(n) for n in self.n])
        self.need = np.maximum(self.n - self.q + 1 - self.q * self.d, 1)
        self.size_class = classes(self.n)
        self.codes: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # by class: seed and steps of each repeat, and what each item reads (END: not of the class)
        for c in np.unique(self.size_class[self.n > 0]).tolist():
            mine = np.flatnonzero((self.size_class == c) & (self.n > 0))
            self.codes[c] = []
            for r in range(repeats_of(c, recall) if repeats is None else repeats[c]):
                seed, steps = sampled(c, r, min(1 << c, MOST_STEPS))
                codes = np.zeros(len(self.n), U64)
                codes[mine] = walk(self.h, self.start[mine], self.n[mine], seed, steps)
                self.codes[c].append((seed, steps, codes))
        self.grams: list[tuple[int, np.ndarray, np.ndarray]] = []  # by q: sorted hashes and whose they are
        for q in (1, 2, 3):
            g, ok = run_hashes(self.h, q), whole(first, q, len(self.h))
            owner = rows_of(first)[: len(g)]
            ok &= self.q[owner] == q
            pairs = np.unique(np.stack([g[ok], owner[ok].astype(U64)]), axis=1)
            if pairs.shape[1]:
                self.grams.append((q, pairs[0], pairs[1].astype(np.int64)))

    def stretches(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, window start) pairs that pass the count filter, in a slice of documents."""
        found: list[np.ndarray] = []
        row = rows_of(first)
        for q, grams, owner in self.grams:
            g = run_hashes(h, q)
            lo = np.searchsorted(grams, g, "left")
            hit = np.flatnonzero((lo < len(grams)) & (grams[np.minimum(lo, len(grams) - 1)] == g) & whole(first, q, len(h)))
            if not len(hit):
                continue
            many = np.searchsorted(grams, g[hit], "right") - lo[hit]
            at = np.repeat(hit, many)
            item = owner[np.repeat(lo[hit], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.lexsort((at, item, row[at]))
            at, item = at[order], item[order]
            other = np.arange(len(at)) + self.need[item] - 1
            fine = other < len(at)
            other = np.minimum(other, len(at) - 1)
            fine &= (item[other] == item) & (row[at[other]] == row[at]) & (at[other] - at <= self.n[item] + self.d[item] - q)
            # a stretch of n + d words that begins at its first hit or before and holds the last that it needs
            low = np.maximum(at[other[fine]] + q - self.n[item[fine]] - self.d[item[fine]], first[row[at[fine]]])
            count = at[fine] - low + 1
            who = np.repeat(np.arange(len(low)), count)
            begin = low[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.unique(np.stack([item[fine][who], begin]), axis=1))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def candidates(self, h: np.ndarray, first: np.ndarray, items: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which stretches belong to a pair of row and item of which a window reads the item's word at a sampled step."""
        row = np.searchsorted(first, begins, "right") - 1
        room = np.minimum(self.n[items], first[row + 1] - begins)
        pairs, pair = np.unique(row * len(self.n) + items, return_inverse=True)
        met = np.zeros(len(pairs), bool)
        for c in np.unique(self.size_class[items]).tolist():
            left = np.flatnonzero(self.size_class[items] == c)
            if not self.codes[c]:
                met[pair[left]] = True
            for seed, steps, codes in self.codes[c]:
                left = left[~met[pair[left]]]
                if not len(left):
                    break
                read = walk(h, begins[left], room[left], seed, steps)
                met[pair[left[(read == codes[items[left]]) & (read != END)]]] = True
        return met[pair]

    def matches(self, h: np.ndarray, first: np.ndarray, most: int = 1 << 20, once: bool = False) -> tuple[np.ndarray, ...]:
        """(row, item, distance, start, length) of each item in each row of a slice: its nearest stretch, leftmost of equals.

        most: words of stretches held at a time. once: rows of which a candidate pair matches may lack their other items.
        """
        items, begins = self.stretches(h, first)
        met = self.candidates(h, first, items, begins) if len(items) else np.zeros(0, bool)
        out = self.verified(h, first, items[met], begins[met], most)
        if once and out:
            met |= np.isin(np.searchsorted(first, begins, "right") - 1, np.concatenate(out, axis=1)[0])
        out += self.verified(h, first, items[~met], begins[~met], most)
        all_ = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        order = np.lexsort((all_[3], all_[2], all_[1], all_[0]))
        all_ = all_[:, order]
        new = np.ones(all_.shape[1], bool)
        new[1:] = (all_[0, 1:] != all_[0, :-1]) | (all_[1, 1:] != all_[1, :-1])
        return tuple(all_[:, new])

    def verified(self, h: np.ndarray, first: np.ndarray, items: np.ndarray, begins: np.ndarray, most: int) -> list[np.ndarray]:
        """Columns of row, item, distance, start and length of the stretches within the distance."""
        out = []
        for c in np.unique(self.size_class[items]).tolist():
            mine = np.flatnonzero(self.size_class[items] == c)
            width = int(self.n[items[mine]].max())
            wide = width + width // 5
            step = max(1, most // wide)
            for i in range(0, len(mine), step):
                item, begin = items[mine[i : i + step]], begins[mine[i : i + step]]
                row = np.searchsorted(first, begin, "right") - 1
                room = first[row + 1] - begin
                size = np.minimum(self.n[item] + self.d[item], room)
                best, length = edit_distances(rectangles(self.h, self.start[item], self.n[item], width), self.n[item], rectangles(h, begin, size, wide), size)
                good = best <= self.d[item]
                out.append(np.stack([row, item, best, begin - first[row], length])[:, good])
        return out


def item_blocks(benchmark: DataFrame, item_bytes: int, item_key: str, item_text: str) -> list[DataFrame]:
    """The items with a text, in blocks of about item_bytes that go to the workers one by one."""
    own = benchmark.select(benchmark[item_key].cast("bigint").alias("i"), benchmark[item_text].alias("t")).where("t IS NOT NULL")
    parts = max(1, ceil((own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / item_bytes))
    return [own.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == p) for p in range(parts)]


def collected(block: DataFrame, recall: float) -> tuple[list[int | None], list[str], dict[int, int]]:
    """Ids and texts of a block, and the repeats of its classes of lengths, found once for all tasks."""
    rows = sorted(block.collect(), key=lambda r: (r["i"] is None, r["i"] or 0, r["t"]))
    texts = [r["t"] for r in rows]
    found = np.unique(classes(np.diff(word_hashes(*buffers(pa.array(texts, pa.string())))[1])))
    return [r["i"] for r in rows], texts, {c: repeats_of(c, recall) for c in found.tolist()}


def without_leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, item_bytes: int = 8 << 20, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns kept, that hold no benchmark item: one narrow pass per block of items."""
    for block in item_blocks(benchmark, item_bytes, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(collected(block, recall))

        def make(shared=shared):
            ids, texts, repeats = shared.value
            items = Items(list(range(len(ids))), texts, repeats=repeats)

            def count(column: pa.Array) -> list[pa.Array]:
                raw, offsets = buffers(column)
                found = np.zeros(len(column), np.int64)
                for i, j, cut, cut_offsets in slices(raw, offsets):
                    found[i:j] = np.bincount(items.matches(*word_hashes(cut, cut_offsets), once=True)[0], minlength=j - i)
                return [pa.array(found)]

            return count

        leaks_ = fresh(docs, "leaks")
        docs = annotated(docs, text, [(leaks_, "bigint")], make).where(F.col(leaks_) == 0).drop(leaks_)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, item_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, edits, first_word (from 0) and n_words of each benchmark item that a document holds."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    small_batches(spark)
    held = item_blocks(benchmark, item_bytes, item_key, item_text)

    def one_pass(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(collected(block, recall))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts, repeats = shared.value
            items = Items(list(range(len(ids))), texts, repeats=repeats)
            id_column = pa.array(ids, pa.int64())
            for b in batches:
                raw, offsets = buffers(b.column(1))
                for i, _, cut, cut_offsets in slices(raw, offsets):
                    row, item, edits, first_word, n_words = items.matches(*word_hashes(cut, cut_offsets))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + row)), id_column.take(pa.array(item)), pa.array(edits, pa.int32()), pa.array(first_word), pa.array(n_words)], ["id", "item_id", "edits", "first_word", "n_words"])

        return docs.select(docs[key], docs[text]).mapInArrow(run, f"id {kind}, item_id bigint, edits int, first_word bigint, n_words bigint")

    return reduce(DataFrame.unionByName, map(one_pass, held)).withColumnRenamed("id", key)
