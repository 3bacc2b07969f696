"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A word's count is its number of initial symbols minus the merges made; the merges are found by popping
the lowest-rank adjacent pair from a heap over a linked list of symbols. Words repeat, so each worker
keeps the counts of the words it has met in a table of bounded size (it is emptied when full; that costs
time, never a result).

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; other
columns are ignored; an empty table gives no rows. Memory follows one Arrow batch. Letters and numbers are those of
the installed regex library; on characters that came into Unicode after the tokenizer library's table (version 16)
the split into words, and so the count, may differ from that library's.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanloom.llm.runtime import small_batches

WORDS_KEPT = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 characters stand
    for themselves, the others for code points from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class WordCounter(dict):
    """word -> number of tokens; missing words are merged when asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self[word] = self.merge(word)
        return n

    def merge(self, word: str) -> int:
        """Tokens of one word: pop the lowest-rank pair, leftmost first, until no adjacent pair has a rank."""
        symbols = [self.alphabet[b] for b in word.encode()]
        n = len(symbols)
        symbols[-1] += self.end
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or ranks.get((symbols[i], symbols[j])) != r:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return sum(map(self.__getitem__, self.pattern.findall(text.lower())))

    def count(self, text: str) -> int:
        if self.special is None or "<" not in text or not (found := len(self.special.findall(text))):
            return self.plain(text)
        return found + sum(map(self.plain, self.special.split(text)))


_LOADED: dict[str, WordCounter] = {}


def loaded(path: str) -> WordCounter:
    if path not in _LOADED:
        _LOADED[path] = WordCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds nothing to the input: returns key, n_bytes, n_tokens and over_limit (n_tokens > limit) per row.

    One narrow pass: no shuffle, no model state beyond the vocabulary file, which each worker reads at `vocabulary`.
    """
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary)
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                n_bytes.append(len(t) if t.isascii() else len(t.encode()))
                n_tokens.append(counter.count(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", key)
