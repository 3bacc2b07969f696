"""Encoding to and decoding from sentence pieces (byte-pair models) by vectorised merge rounds.

The distinct words of a slice of texts become one flat array of symbols. Each round takes, by a segmented
minimum, every word's best pair rank, merges the leftmost such pair of every word at once (all its
non-overlapping occurrences where the merged piece cannot start a better pair, so order does not matter),
and compacts the arrays; words without a pair leave. No piece holds a blank mark after another character,
so words are independent. Characters outside the vocabulary fall back to byte pieces.

Defined cases: null and empty texts encode to begin and end alone and decode to the empty text; repeated rows
each give a row; an empty table gives none; other columns are ignored. Texts of any length are taken whole.
Words met are kept in a table of bounded size per worker.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.runtime import annotated, fresh, small_batches


BLANK = "▁"
NONE = np.int32(2**31 - 1)
WORDS_KEPT = 250_000
SLICE_CHARS = 1 << 20

codecs.register_error("one_mark_per_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The tables of one model: symbols, pair ranks, and the bytes that each piece stands for."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.vocab_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.byte_id = np.zeros(256, np.uint32)
        surface = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                surface.append(b"")
            else:
                surface.append(" ⁇ ".encode() if model.is_unknown(i) else name.replace(BLANK, " ").encode())
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)])[:-1]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        # a symbol is a piece's id, or the vocabulary's size plus the code point of a character that is no piece
        self.symbol = np.arange(0x110000, dtype=np.int32) + n
        for name, i in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        scores = {name: model.get_score(i) for name, i in normal.items()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = []
        sym = lambda s: normal.get(s, n + ord(s) if len(s) == 1 else None)
        for name, i in normal.items():
            for k in range(1, len(name)):
                left, right = sym(name[:k]), sym(name[k:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank_of[scores[name]], i))
        self.span = n + 0x110000
        table = np.array(pairs, np.int64).reshape(-1, 4)
        keys = table[:, 0] * self.span + table[:, 1]
        order = np.argsort(keys)
        self.pair_key, self.pair_rank, self.pair_piece = keys[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32)
        # a rank is safe if one piece alone has it and no pair with that piece has as good a rank
        users = np.bincount([rank_of[s] for s in scores.values()], minlength=len(rank_of))
        own = {i: rank_of[scores[name]] for name, i in normal.items()}
        self.safe = users == 1
        for left, right, r, _ in pairs:
            for part in (left, right):
                if own.get(part, -1) >= r:
                    self.safe[own[part]] = False
        # blank runs: equal ranks, below all others, for every length up to the longest: cut off from the left, longest first
        runs = sorted(len(name) for name in normal if len(name) > 1 and not name.strip(BLANK))
        tied = {rank_of[scores[BLANK * k]] for k in runs}
        whole = runs == list(range(2, len(runs) + 2)) and tied == {len(rank_of) - 1} and users[-1] == len(runs)
        self.run = runs[-1] if runs and whole else 0
        self.words = re.compile(f"{BLANK}+[^{BLANK}]*" if not self.run else f"{BLANK}{{{self.run}}}(?={BLANK})|{BLANK}+[^{BLANK}]*")
        self.kept: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.pair_key, key), max(len(self.pair_key) - 1, 0))
        if not len(self.pair_key):
            return np.full(len(key), NONE), np.zeros(len(key), np.int32)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_piece[at]

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The symbols of each word after all merges."""
        lens = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.symbol[points], np.repeat(np.arange(len(words)), lens)
        done: list[np.ndarray] = [sym[:0]] * len(words)
        rank = np.full(len(sym), NONE)
        piece = np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], piece[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, start)
            size = np.diff(start, append=len(sym))
            if (over := best == NONE).any():
                for k in np.flatnonzero(over):
                    done[word[start[k]]] = sym[start[k] : start[k] + size[k]]
                keep = np.repeat(~over, size)
                sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
                best, size = best[~over], size[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            new_word = np.diff(word[at], prepend=-1) != 0
            # of touching occurrences (a pair of equal symbols) every other one, counted from the left
            fresh = new_word | (np.diff(at, prepend=-2) > 1)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(self.safe[rank[at]] & ((np.arange(len(at)) - begin) % 2 == 0)) | new_word]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[touched] = NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], piece[touched] = self.ranks(sym[touched], sym[touched + 1])
        return done

    def as_ids(self, symbols: np.ndarray) -> bytes:
        if (symbols < self.size).all():
            return symbols.astype("<u4").tobytes()
        out = []
        for s in symbols.tolist():
            if s < self.size:
                out.append(np.array([s], "<u4"))
            else:
                out.append(self.byte_id[np.frombuffer(chr(s - self.size).encode(), np.uint8)].astype("<u4"))
        return np.concatenate(out).tobytes()

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and BLANK not in text and text[0] != " ":
            return text.split(" ")  # each stands for a blank mark and itself
        return [w[1:] for w in self.words.findall(BLANK + text.replace(" ", BLANK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian 32-bit integers, with begin and end."""
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.bos, self.eos))
        out, i = [], 0
        while i < len(texts):
            parts, chars = [], 0
            while i < len(texts) and (chars < SLICE_CHARS or not parts):
                parts.append(self.split(texts[i]))
                chars += len(texts[i])
                i += 1
            if len(self.kept) > WORDS_KEPT:
                self.kept.clear()
            if missing := list(set().union(*parts).difference(self.kept)):
                self.kept.update(zip(missing, map(self.as_ids, self.merge_words([BLANK + w for w in missing])), strict=True))
            out += [begin + b"".join(map(self.kept.__getitem__, p)) + end for p in parts]
        return out

    def decode(self, ids: Iterable[bytes]) -> list[str]:
        """The texts of id sequences; each loses the blank that encoding puts in front."""
        out, group, size = [], [], 0
        ids = list(ids)
        for k, one in enumerate(ids):
            group.append(one)
            size += len(one)
            if size < 4 * SLICE_CHARS and k + 1 < len(ids):
                continue
            flat = np.frombuffer(b"".join(group), "<u4").astype(np.int64)
            lens = self.surface_len[flat]
            ends = np.cumsum(lens)
            raw = self.surface[np.repeat(self.surface_at[flat] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            cut = np.concatenate([[0], ends])[np.cumsum([0] + [len(g) // 4 for g in group])]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out.append(raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "one_mark_per_byte"))
            group, size = [], 0
        return out


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_and_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids (binary, little-endian 32-bit), n_tokens and decoded (the text that the ids give).

    One narrow pass without a shuffle; workers read the model file at `model`.
    """
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(pieces.decode(ids), pa.string())],
                    ["id", "ids", "n_tokens", "decoded"],
                )

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", key)


def with_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The documents, all columns kept but the text, which is what its ids give back, and ids and n_tokens (which replace columns of these names)."""

    def code(column: pa.Array) -> list[pa.Array]:
        pieces = loaded(model)
        ids = pieces.encode([t or "" for t in column.to_pylist()])
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(pieces.decode(ids), pa.string())]

    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("ids", "n_tokens") or c == text])
    ids_, n_, decoded_ = (fresh(docs, c) for c in ("ids", "n_tokens", "decoded"))
    coded = annotated(docs, text, [(ids_, "binary"), (n_, "bigint"), (decoded_, "string")], lambda: code)
    return coded.select(*[F.col(decoded_).alias(c) if c == text else F.col(c) for c in docs.columns], F.col(ids_).alias("ids"), F.col(n_).alias("n_tokens"))
