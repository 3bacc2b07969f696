"""Language identification by hierarchical discrimination: the family first, then the language within it.

A text is a vector of hashed byte n-grams of one to four bytes (A-Z in lower case, ASCII characters other than letters as
blanks), square roots of shares, so of length one. One linear support vector machine for each family tells it from all others; within
the family that scores highest, one machine for each pair of languages votes, and the language with most votes
is predicted (of equally many the one with the larger sum of margins, then the first by name).

Machines learn from at most `max_rows` rows of a language (a family's own and, when it is a counterexample, as many of
each family: those whose key and text hash lowest), all of them whole texts; each machine is trained in a task of its own by dual
coordinate descent. The weights, (families + pairs within families) x 2^bits floats, go to the workers by broadcast;
scoring is one narrow pass over all rows.

Families: a fixed table of common codes; a language that is not in it is a family of its own. Defined cases: null texts and texts
without a letter are `und` with score 0; so is everything if no row has both a language and a letter; null languages teach
nothing; repeated rows are learned from once and each give a row; other columns are ignored; empty tables give no rows.
Long texts are counted in pieces, so memory follows one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrays import LOWER, buffers, slices
from spanloom.llm.runtime import discard, small_batches, written

#: Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "iranian": "fa ku ps tg",
    "malayo-polynesian": "id jv ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"
GRAMS = 4
#: Bytes and rows counted at once.
PIECE, ROWS = 1 << 20, 128

LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[0x80:] = np.arange(0x80, 0x100)
LETTERS = LETTERS[LOWER]


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def grams(raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """How often each hashed n-gram stands in each row: rows x 2^bits. N-grams do not cross rows."""
    n, folded = len(offsets) - 1, LETTERS[raw]
    counts = np.zeros(n << bits, np.int64)
    for p in range(0, len(raw), PIECE):
        end = min(p + PIECE, len(raw))
        first, last = np.searchsorted(offsets, [p, end - 1], "right") - 1
        sizes = np.diff(np.clip(offsets[first : last + 2], p, end))
        row = np.repeat(np.arange(first, last + 1) << bits, sizes).astype(np.int32)
        left = np.repeat(offsets[first + 1 : last + 2], sizes) - np.arange(p, end)  # bytes up to the row's end
        code, found = np.zeros(end - p, np.uint32), []
        for size in range(1, GRAMS + 1):
            here = folded[p + size - 1 : end + size - 1].astype(np.uint32)
            code = (code[: len(here)] << np.uint32(8)) | here
            at = ((code ^ np.uint32(size * 0x3C6EF35F & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            found.append((row[: len(here)] + at.astype(np.int32))[left[: len(here)] >= size])
        counts += np.bincount(np.concatenate(found), minlength=len(counts))
    return counts.reshape(n, 1 << bits)


def vectors(raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Square roots of the n-grams' shares, so that a row's squares add up to one."""
    x = grams(raw, offsets, bits).astype(np.float32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return np.sqrt(x, out=x)


def in_blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of at most ROWS rows."""
    for i, j, part, at in slices(raw, offsets):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            yield a, b, part[at[a - i] : at[b - i]], at[a - i : b - i + 1] - at[a - i]


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a letter of any script; only rows without an ASCII letter are looked at character by character."""
    low = LOWER[raw]
    ascii_, other = (np.concatenate([[0], np.cumsum(x)]) for x in ((low >= ord("a")) & (low <= ord("z")), raw >= 0x80))
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found & (other[offsets[1:]] > other[offsets[:-1]])).tolist():
        found[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = 10.0, sweeps: int = 40) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine with squared hinge loss: dual coordinate descent over sparse rows (places, values).

    Both sides weigh alike, whatever their numbers of rows.
    """
    w, dual = np.zeros(size + 1), np.zeros(len(rows))
    weight = np.where(signs > 0, len(rows) / 2 / max(1, (signs > 0).sum()), len(rows) / 2 / max(1, (signs < 0).sum())) * cost
    diagonal = 0.5 / weight
    squares = np.array([v @ v + 1 for _, v in rows]) + diagonal
    order = np.random.default_rng(0)
    for _ in range(sweeps):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            at, v = rows[i]
            slope = signs[i] * (w[at] @ v + w[-1]) - 1 + diagonal[i] * dual[i]
            new = max(dual[i] - slope / squares[i], 0.0)
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                w[at] += step * v
                w[-1] += step
                moved, dual[i] = max(moved, abs(new - dual[i])), new
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class LanguageModel:
    """Families in order, their languages, and the machines: one for each family, then one for each pair (first language: positive)."""

    bits: int
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None  # float32, machines x (2^bits + 1)

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        raw, offsets = buffers(column)
        n = len(offsets) - 1
        names, scores = [UNDETERMINED] * n, [0.0] * n
        if not self.families:
            return names, scores
        place = {pair: len(self.families) + k for k, pair in enumerate(self.pairs)}
        for i, j, part, at in in_blocks(raw, offsets):
            letters = has_letter(part, at)
            margins = vectors(part, at, self.bits) @ self.weights[:, :-1].T + self.weights[:, -1]
            share = np.exp(2 * (margins[:, : len(self.families)] - margins[:, : len(self.families)].max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            for r in np.flatnonzero(letters).tolist():
                f = int(share[r].argmax())
                names[i + r], sure = self.within(self.languages[self.families[f]], margins[r], place)
                scores[i + r] = float(share[r, f]) * sure
        return names, scores

    @staticmethod
    def within(languages: list[str], margins: np.ndarray, place: dict[tuple[str, str], int]) -> tuple[str, float]:
        """The language with most votes, and the mean over its machines of how sure they are."""
        best = None
        for lang in languages:
            own = [margins[place[lang, o]] if lang < o else -margins[place[o, lang]] for o in languages if o != lang]
            rank = (sum(m > 0 for m in own), sum(own))
            if best is None or rank > best[0]:
                best = (rank, lang, float(np.mean([1 / (1 + np.exp(-2 * m)) for m in own])) if own else 1.0)
        return best[1], best[2]


def sample(docs: DataFrame, usable: Column | None, key: str, text: str, lang: str, max_rows: int, bits: int) -> DataFrame:
    """lang, family, h, places, values: at most max_rows texts of a language, drawn by hash."""
    if usable is not None:
        docs = docs.where(usable)
    known = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("t"), F.xxhash64(docs[key], docs[text]).alias("draw")).where("lang IS NOT NULL AND t IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language: less than the model that follows
    # about twice as many as are wanted pass, so that no task has to rank a whole language
    passes = F.pmod("draw", F.lit(1 << 30)) * F.col("n") < F.lit((2 * max_rows + 50) << 30)
    few = known.join(F.broadcast(sizes), "lang").where(passes).select("lang", F.xxhash64("t").alias("h"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(2))
            for i, j, part, at in in_blocks(raw, offsets):
                x = vectors(part, at, bits)
                used = [np.flatnonzero(r).astype("<i4") for r in x]
                values = [r[u].astype("<f4").tobytes() for r, u in zip(x, used, strict=True)]
                langs, h = (b.column(c).slice(i, j - i) for c in (0, 1))
                families = pa.array([family_of(k) for k in langs.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([langs, families, h, pa.array(has_letter(part, at)), pa.array([u.tobytes() for u in used], pa.binary()), pa.array(values, pa.binary())], ["lang", "family", "h", "ok", "places", "values"])

    coded = few.mapInArrow(run, "lang string, family string, h bigint, ok boolean, places binary, values binary").where("ok")
    once = coded.groupBy("lang", "family", "h").agg(F.min(F.struct("places", "values")).alias("x"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("number", number).where(F.col("number") <= max_rows).select("lang", "family", "h", "x.places", "x.values")


def fit(docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 400, bits: int = 15) -> LanguageModel:
    """Learn from the rows that `usable` allows: at most max_rows texts of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(sample(docs, usable, key, text, lang, max_rows, bits))
    languages: dict[str, list[str]] = {}
    for name in sorted(r["lang"] for r in rows.select("lang").distinct().collect()):  # languages, not rows
        languages.setdefault(family_of(name), []).append(name)
    families = sorted(languages)
    pairs = [p for f in families for p in combinations(languages[f], 2)]
    if not families:
        discard(rows)
        return LanguageModel(bits)
    # each machine's rows: a family's own against bounded numbers of all others', a language's own against those of one other
    number = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("h"), "h"))
    each = rows.select("*", number.alias("number"), F.posexplode(F.array(*map(F.lit, families))).alias("task", "a")).where(F.expr(f"family = a OR number <= {max_rows}"))
    of_families = each.select("task", "h", F.when(F.col("family") == F.col("a"), 1).otherwise(-1).alias("sign"), "places", "values")
    sides = [(lang, len(families) + k, sign) for k, pair in enumerate(pairs) for lang, sign in zip(pair, (1, -1), strict=True)]
    of_pairs = rows.join(F.broadcast(spark.createDataFrame(sides, "lang string, task int, sign int")), "lang").select("task", "h", "sign", "places", "values")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sign", "h"])
        sparse = [(np.frombuffer(p, "<i4"), np.frombuffer(v, "<f4").astype(float)) for p, v in zip(group.places, group["values"], strict=True)]
        w = machine(sparse, group.sign.to_numpy(float), 1 << bits)
        return pd.DataFrame({"task": [int(group.task.iloc[0])], "w": [w.astype("<f4").tobytes()]})

    found = of_families.unionByName(of_pairs).groupBy("task").applyInPandas(train, "task int, w binary").collect()  # the model
    discard(rows)
    weights = np.zeros((len(families) + len(pairs), (1 << bits) + 1), np.float32)
    for r in found:
        weights[r["task"]] = np.frombuffer(r["w"], "<f4")
    return LanguageModel(bits, families, languages, pairs, weights)


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1: the family's share times how sure its machines are) per row."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)
