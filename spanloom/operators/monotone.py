"""Monotone alignment of two segment sequences in windows, and the similarities it scores with."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def common_marks(target: list[str], source: list[str]) -> list[int]:
    """Places of target that lie on a longest common subsequence; of equal ways the one that drops target's last token."""
    m, n = len(target), len(source)
    best = np.zeros((m + 1, n + 1), np.int32)
    for i in range(1, m + 1):
        above, here = best[i - 1], best[i]
        same = [target[i - 1] == s for s in source]
        for j in range(1, n + 1):
            here[j] = above[j - 1] + 1 if same[j - 1] else max(above[j], here[j - 1])
    marks, i, j = [], m, n
    while i and j:
        if target[i - 1] == source[j - 1]:
            i, j = i - 1, j - 1
            marks.append(i)
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return marks


def union_recall(source: list[list[str]], target: list[list[str]]) -> float:
    """Share of target tokens on a common subsequence with any source sentence, each source token paid once."""
    left, hits, total = Counter(t for s in source for t in s), 0, sum(map(len, target))
    for sentence in target:
        for k in sorted({k for s in source for k in common_marks(sentence, s)}):
            if left[sentence[k]] > 0:
                left[sentence[k]] -= 1
                hits += 1
    return hits / total if total else 0.0


def in_band(s: int, t: int, n_source: int, lead: int = 10, trail: float = 0.25) -> bool:
    """Whether a cell is visited: targets run ahead by `lead` at most, and long sources do not leave them behind."""
    return t - s <= lead and not (n_source >= 50 and (t + 1) / (s + 1) < trail)


def align(source: list, target: list, score: Callable, max_source: int = 4, max_target: int = 4, size_penalty: float = 0.03, skip_penalty: float = 0.0, least: float = 0.0,
          lead: int = 10, trail: float = 0.25, source_paragraphs: list[int] | None = None, target_paragraphs: list[int] | None = None) -> list[tuple[list[int], list[int], float, float]]:
    """Rows (source indices, target indices, accumulated score, own score) that cover both sequences in order.

    score(window of source, window of target). Smaller windows win ties. Cells outside of the band count 0 and end
    the way back: what is left comes out unaligned, sources first. Windows that reach before the start are not taken.
    """
    n, m = len(source), len(target)
    sums, rows = np.zeros((n, m)), {}
    windows = sorted(((w, v) for w in range(1, max_source + 1) for v in range(max_target + 1)), key=sum)
    mixed = lambda paragraphs, a, b: paragraphs is not None and len(set(paragraphs[a:b])) > 1
    for t in range(m):
        for s in range(n):
            if not in_band(s, t, n, lead, trail):
                continue
            best = None
            for w, v in windows:
                a, b = s - w + 1, t - v + 1
                if a < 0 or b < 0 or mixed(source_paragraphs, a, s + 1) or mixed(target_paragraphs, b, t + 1):
                    continue
                total, own = (sums[a - 1, b - 1] - (skip_penalty if not v else 0) if a and b else 0.0), 0.0
                if v:
                    own = max(0.0, score(source[a : s + 1], target[b : t + 1]) - (max(w, v) - 1) * size_penalty)
                    own = own if own >= least else 0.0
                    total += own * v
                if best is None or total > best[0]:
                    best = (total, own, a, b)
            if best is not None:
                sums[s, t], rows[s, t] = best[0], best
    out, s, t = [], n - 1, m - 1
    while s >= 0 or t >= 0:
        if (s, t) not in rows:
            out += [([], [k], 0.0, 0.0) for k in range(t, -1, -1)] + [([k], [], 0.0, 0.0) for k in range(s, -1, -1)]
            break
        total, own, a, b = rows[s, t]
        out.append((list(range(a, s + 1)), list(range(b, t + 1)), float(total), float(own)))
        s, t = a - 1, b - 1
    return out[::-1]


def grams(tokens: list[str], n: int) -> list:
    """Runs of n tokens; single tokens stand for themselves."""
    return tokens if n == 1 else list(zip(*(tokens[k:] for k in range(n)), strict=False))


def gram_recall(n: int) -> Callable:
    """Share of the target window's n-grams that the source window has (repeats count as often as both have them); n-grams cross segments."""

    def score(source: list[list[str]], target: list[list[str]]) -> float:
        a, b = (Counter(grams([t for s in side for t in s], n)) for side in (source, target))
        return sum((a & b).values()) / max(sum(b.values()), 1)

    return score


#: Scores of the windows that end in target t and in the sources from lo to hi: depths x widths x (hi - lo). Windows that reach
#: before the start may hold anything.
RowScores = Callable[[int, int, int], np.ndarray]
#: Sources whose windows are counted at a time.
CHUNK = 512
#: Cells whose choices are held at a time (17 bytes each).
HELD = 1 << 21


class Blocked:
    """Scores of a block of neighbouring targets at a time, kept until another block is asked for.

    Blocks of long sources have fewer targets, so memory grows with the source's length, not with the product of both.
    """

    def __init__(self, n: int, m: int, widths: int, depths: int):
        self.n, self.m, self.widths, self.depths = n, m, widths, depths
        self.size = 64 if n <= 96 else max(1, min(16, (1 << 18) // n))
        self.at, self.lo, self.hi, self.kept = -1, 0, 0, np.zeros(0)

    def block(self, first: int, last: int, lo: int, hi: int) -> np.ndarray:
        """(last - first) x depths x widths x (hi - lo)"""
        raise NotImplementedError

    def __call__(self, t: int, lo: int, hi: int) -> np.ndarray:
        at = t // self.size
        if at != self.at or lo < self.lo or hi > self.hi:
            first = at * self.size
            # of the targets to come the band reaches some sources further
            self.at, self.lo, self.hi = at, lo, hi if hi == self.n else min(self.n, hi + 4 * (first + self.size - t))
            self.kept = self.block(first, min(first + self.size, self.m), self.lo, self.hi)
        return self.kept[t % self.size, :, :, lo - self.lo : hi - self.lo]


class Places:
    """The n-grams of segments in order: number, first and last segment of each, without those of more than `most` segments."""

    def __init__(self, segments: list[list[str]], n: int, most: int, numbers: dict, grow: bool):
        tokens, at = [t for s in segments for t in s], np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        every = grams(tokens, n)
        number = np.array([numbers.setdefault(g, len(numbers)) for g in every] if grow else [numbers.get(g, -1) for g in every], np.int64)
        first, last = at[: len(every)], at[n - 1 : n - 1 + len(every)]
        near = last - first < most
        self.number, self.first, self.last = number[near], first[near], last[near]

    def between(self, lo: int, hi: int) -> slice:
        """Those that start in the segments from lo to hi."""
        return slice(*np.searchsorted(self.first, [lo, hi]))

    def counts(self, some: slice, number: np.ndarray, n: int, lo: int, hi: int, most: int) -> np.ndarray:
        """most x (hi - lo) x n: how often each n-gram, as renumbered (-1: left out), stands in the windows of 1 to `most` segments that end from lo to hi."""
        first, last = self.first[some], self.last[some]
        ends = first + np.arange(most)[:, None]  # the longer window that it is the first to start in
        used = (ends >= last) & (ends >= lo) & (ends < hi) & (number >= 0)
        w, k = np.nonzero(used)
        at = (w * (hi - lo) + ends[used] - lo) * n + number[k]
        out = np.bincount(at, minlength=most * (hi - lo) * n).astype(np.int32).reshape(most, hi - lo, n)
        for k in range(1, most):
            out[k] += out[k - 1]
        return out


class GramRows(Blocked):
    """gram_recall of all windows, a block of targets at a time.

    What two windows share of an n-gram is the number of k that both have it k times or more, so shared counts are a product of two
    tables of zeros and ones, whose columns are the n-grams of the block's targets (repeats have columns of their own).
    """

    def __init__(self, source: list[list[str]], target: list[list[str]], n: int = 1, widths: int = 4, depths: int = 4):
        super().__init__(len(source), len(target), widths, depths)
        numbers: dict = {}
        self.target = Places(target, n, depths, numbers, True)
        self.source = Places(source, n, widths, numbers, False)
        self.number = len(numbers)

    def block(self, first: int, last: int, lo: int, hi: int) -> np.ndarray:
        size, out = last - first, np.zeros((last - first, self.depths, self.widths, hi - lo))
        asked = self.target.between(max(first - self.depths + 1, 0), last)
        total = self.target.counts(asked, np.zeros(asked.stop - asked.start, np.int64), 1, first, last, self.depths)[:, :, 0].T
        used, here = np.unique(self.target.number[asked], return_inverse=True)
        new = np.full(self.number + 1, -1)  # numbers of -1 read the last place
        new[used] = np.arange(len(used))
        wanted = self.target.counts(asked, here, len(used), first, last, self.depths).transpose(1, 0, 2).reshape(size * self.depths, -1)
        most = wanted.max(axis=0, initial=0)
        for a in range(lo, hi, CHUNK):
            b = min(a + CHUNK, hi)
            some = self.source.between(max(a - self.widths + 1, 0), b)
            number = new[self.source.number[some]]
            if not (number >= 0).any():
                continue
            have = self.source.counts(some, number, len(used), a, b, self.widths).reshape(self.widths * (b - a), -1)
            both = np.minimum(have.max(axis=0), most)
            column = np.repeat(np.arange(len(used)), both)
            level = np.arange(len(column)) - np.repeat(np.cumsum(both) - both, both) + 1
            if len(column):
                shared = (wanted[:, column] >= level).astype(np.float32) @ (have[:, column] >= level).astype(np.float32).T
                out[..., a - lo : b - lo] = shared.reshape(size, self.depths, self.widths, b - a)
        return out / np.maximum(total, 1)[:, :, None, None]


def mark_bits(target: list[str], source: dict[str, int], size: int) -> int:
    """common_marks as bits. source: for each token the bits of its places among `size`.

    A row's cleared bits are the places at which the length grows, so lengths are counts of cleared bits.
    """
    every = (1 << size) - 1
    rows, at = [every], []
    for token in target:
        here, row = source.get(token, 0), rows[-1]
        at.append(here)
        if (both := row & here):
            row = (row + both | row - both) & every
        rows.append(row)
    marks, i, j = 0, len(target), size
    while i and j:
        if at[i - 1] >> j - 1 & 1:
            i, j = i - 1, j - 1
            marks |= 1 << i
            continue
        first = (1 << j) - 1
        # without target's last token the length is that of the row above, without source's that of this row up to the place before
        if j - (rows[i - 1] & first).bit_count() >= j - 1 - (rows[i] & first >> 1).bit_count():
            i -= 1
        else:
            j -= 1
    return marks


def many_marks(targets: np.ndarray, sizes: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """mark_bits of many pairs at once, of at most 64 tokens a side, longest targets first. targets: pairs x tokens, as rows of places; sizes:
    tokens of each pair's target; places: rows x pairs, the bits of a token's places in each pair's source; ends: tokens of each source.

    On the way back a target token that is not dropped meets its last place in what is left of the source, as the source's
    tokens behind it are dropped first.
    """
    one, every = np.uint64(1), ~np.uint64(0)
    # of the pairs whose targets have that many tokens
    upto = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), "right")
    rows, at = [np.full(len(sizes), every)], [np.zeros(0, np.uint64)]
    for i in range(1, len(upto)):
        row, here = rows[-1][: upto[i]], places[targets[: upto[i], i - 1], np.arange(upto[i])]
        both = row & here
        at.append(here)
        rows.append(row + both | row - both)
    marks, j = np.zeros(len(sizes), np.uint64), ends.astype(np.uint64)
    for i in range(len(upto) - 1, 0, -1):
        n = upto[i]
        left = j[:n]
        first = np.where(left > 0, every >> (np.uint64(64) - np.maximum(left, one)), np.uint64(0))
        met = at[i] & first
        # cleared bits are where the length grows: as in mark_bits
        kept = first & ~(first >> one) & met  # the last token of what is left
        grown = np.bitwise_count(~rows[i] & first >> one) > np.bitwise_count(~rows[i - 1][:n] & first)
        taken = (met > 0) & ((kept > 0) | grown)
        marks[:n] |= np.where(taken, one << np.uint64(i - 1), np.uint64(0))
        # the highest bit; without neighbours below it no rounding reaches the next power
        highest = np.frexp((met & ~(met >> one)).astype(np.float64))[1] - 1
        j[:n] = np.where(taken, np.maximum(highest, 0).astype(np.uint64), left)
    return marks


class UnionRows(Blocked):
    """union_recall of all windows, a block of targets at a time.

    For each pair of segments the marked target tokens are bits, of all pairs with a common token made together; windows of
    sources unite them. Of one target segment no token has more marks than the sources have copies, so only tokens that stand in several of
    a window's targets are counted apart.
    """

    def __init__(self, source: list[list[str]], target: list[list[str]], widths: int = 4, depths: int = 4):
        super().__init__(len(source), len(target), widths, depths)
        self.source, self.target = source, target
        numbers: dict = {}
        self.targets = Places(target, 1, depths, numbers, True)
        self.sources = Places(source, 1, widths, numbers, False)
        self.number = len(numbers)
        self.sizes, self.ends = (np.array([len(x) for x in side], np.int64) for side in (target, source))
        self.before, self.behind = (np.concatenate([[0], np.cumsum(x)]) for x in (self.sizes, self.ends))

    def block(self, first: int, last: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((last - first, self.depths, self.widths, hi - lo))
        start = max(first - self.depths + 1, 0)
        asked = self.targets.between(start, last)
        used, here = np.unique(self.targets.number[asked], return_inverse=True)
        new = np.full(self.number + 1, -1)  # numbers of -1 read the last place
        new[used] = np.arange(len(used))
        in_segment = self.targets.counts(asked, here, len(used), start, last, 1)[0] > 0
        words = max(1, -(-int(self.sizes[start:last].max()) // 64))
        # tokens as numbers and as bits of their places: targets x tokens
        tokens = np.full((last - start, 64), len(used))
        spot = np.arange(asked.start, asked.stop) - self.before[self.targets.first[asked]]
        row = self.targets.first[asked] - start
        tokens[row[spot < 64], spot[spot < 64]] = here[spot < 64]
        bits = np.zeros((last - start, len(used), words), np.uint64)
        np.add.at(bits, (row, here, spot // 64), np.uint64(1) << (spot % 64).astype(np.uint64))
        # (target, depth, token) where the token stands in more than one of the window's targets
        within = np.zeros((self.depths, last - first, len(used)), np.int64)
        for v in range(self.depths):
            k = np.arange(first, last) - v
            within[v, k >= 0] = in_segment[k[k >= 0] - start]
        several = np.argwhere((within.cumsum(axis=0) > 1).transpose(1, 0, 2))
        total = np.array([[self.before[t + 1] - self.before[max(t - v, 0)] for v in range(self.depths)] for t in range(first, last)])
        for a in range(lo, hi, CHUNK):
            b = min(a + CHUNK, hi)
            far = max(a - self.widths + 1, 0)
            some = self.sources.between(far, b)
            number = new[self.sources.number[some]]
            if (number >= 0).any():
                have = self.sources.counts(some, number, len(used), a, b, self.widths)
                hits = self.hits(self.united(tokens, in_segment, some, number, start, last, far, a, b, words), have, bits, several, first - start, last - first)
                out[..., a - lo : b - lo] = hits
        return out / np.maximum(total, 1)[:, :, None, None]

    def united(self, tokens: np.ndarray, in_segment: np.ndarray, some: slice, number: np.ndarray, start: int, last: int, far: int, a: int, b: int, words: int) -> np.ndarray:
        """widths x targets x (b - a) x words: the marks of each target by the windows that end in the sources from a to b."""
        known = number >= 0
        row, spot = self.sources.first[some][known] - far, (np.arange(some.start, some.stop) - self.behind[self.sources.first[some]])[known]
        places = np.zeros((in_segment.shape[1] + 1, b - far), np.uint64)
        near = spot < 64
        np.add.at(places, (number[known][near], row[near]), np.uint64(1) << spot[near].astype(np.uint64))
        there = np.zeros((b - far, in_segment.shape[1]), np.float32)
        there[row, number[known]] = 1
        k, s = np.nonzero(in_segment.astype(np.float32) @ there.T)
        own = np.zeros((last - start, b - far, words), np.uint64)
        short = (self.sizes[start + k] <= 64) & (self.ends[far + s] <= 64)
        for x, y in zip(k[~short].tolist(), s[~short].tolist(), strict=True):
            at: dict[str, int] = {}
            for i, token in enumerate(self.source[far + y]):
                at[token] = at.get(token, 0) | 1 << i
            own[x, y] = np.frombuffer(mark_bits(self.target[start + x], at, len(self.source[far + y])).to_bytes(8 * words, "little"), "<u8")
        k, s = k[short], s[short]
        order = np.argsort(-self.sizes[start + k], kind="stable")
        for part in np.array_split(order, -(-len(order) // (1 << 13)) or 1):
            if len(part):
                own[k[part], s[part], 0] = many_marks(tokens[k[part]], self.sizes[start + k[part]], places[:, s[part]], self.ends[far + s[part]])
        out = [own]
        for w in range(1, self.widths):
            longer = out[-1].copy()
            longer[:, w:] |= own[:, :-w]
            out.append(longer)
        return np.stack(out)[:, :, a - far :]

    def hits(self, found: np.ndarray, have: np.ndarray, bits: np.ndarray, several: np.ndarray, skip: int, size: int) -> np.ndarray:
        """size x depths x widths x sources: marked tokens that the source windows have copies left for."""
        marked = np.bitwise_count(found).sum(axis=3, dtype=np.int64).transpose(1, 0, 2)  # targets x widths x sources
        out = np.zeros((size, self.depths, *marked.shape[1:]))
        for v in range(self.depths):
            k = np.arange(size) + skip - v
            out[k >= 0, v:] += marked[k[k >= 0], None]
        several = several[have.any(axis=(0, 1))[several[:, 2]]]
        for part in np.array_split(several, -(-len(several) * marked[0].size // (1 << 18)) or 1):
            if not len(part):
                continue
            t, v, x = part.T
            asked = np.zeros((len(part), *marked.shape[1:]), np.int64)
            for back in range(self.depths):
                on = np.flatnonzero((v >= back) & (t + skip >= back))
                k = t[on] + skip - back
                on, k = on[(there := bits[k, x[on]].any(axis=1))], k[there]
                asked[on] += np.bitwise_count(found[:, k] & bits[k, x[on]][None, :, None, :]).sum(axis=3, dtype=np.int64).transpose(1, 0, 2)
            over = np.maximum(asked - have[:, :, x].transpose(2, 0, 1), 0)
            begin = np.flatnonzero(np.diff(t * self.depths + v, prepend=-1))
            out[t[begin], v[begin]] -= np.add.reduceat(over, begin, axis=0)
        return out


class CosineRows(Blocked):
    """Cosines of window vectors; source and target hold one matrix for each window size from 1."""

    def __init__(self, source: list[np.ndarray], target: list[np.ndarray]):
        super().__init__(len(source[0]), len(target[0]), len(source), len(target))
        self.source, self.target = (np.stack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in side]) for side in (source, target))

    def block(self, first: int, last: int, lo: int, hi: int) -> np.ndarray:
        a, b = self.source[:, lo:hi], self.target[:, first:last].transpose(1, 0, 2)
        return (b.reshape(-1, b.shape[2]) @ a.reshape(-1, a.shape[2]).T).reshape(last - first, self.depths, self.widths, hi - lo)


def band(t: int, n: int, lead: int, trail: float) -> tuple[int, int]:
    """The sources, from and up to, whose cells of target t are visited."""
    hi = n
    if n >= 50 and trail > 0:
        hi = min(n, int((t + 1) / trail) + 2)
        while hi and (t + 1) / hi < trail:
            hi -= 1
    return min(max(t - lead, 0), hi), hi


def same_paragraph(paragraphs: list[int] | None, n: int, most: int) -> np.ndarray:
    """most x n: whether the window of k + 1 segments that ends there is within one paragraph."""
    out = np.ones((most, n), bool)
    if paragraphs is not None:
        p = np.array(paragraphs)
        for k in range(1, most):
            out[k, k:] = out[k - 1, k:] & (p[k:] == p[:-k]) & out[k - 1, k - 1 : -1]
    return out


class Recurrence:
    """The best sums of one target from those of the `depths` targets before it: arrays of n + 1, the first for what lies before the start.

    Targets before the start have minus infinity for all sources but the one just before the start, which has zeros.
    """

    def __init__(self, n: int, scores: RowScores, widths: int, depths: int, size_penalty: float, skip_penalty: float, least: float, lead: int, trail: float, source_paragraphs: list[int] | None, target_paragraphs: list[int] | None, m: int):
        self.n, self.scores, self.widths, self.depths, self.least, self.skip = n, scores, widths, depths, least, skip_penalty
        self.band = lambda t: band(t, n, lead, trail)
        order = sorted(((w, v) for w in range(1, widths + 1) for v in range(depths + 1)), key=sum)
        #: Windows by rank: the first of equally good ones is taken. Rank 0 leaves one source out.
        self.windows = order
        self.alone = [(k, w) for k, (w, v) in enumerate(order) if not v]
        both = [(k, w, v) for k, (w, v) in enumerate(order) if v]
        self.ranks, self.places = np.array([k for k, _, _ in both], np.int8), np.array([(v - 1) * widths + w - 1 for _, w, v in both])
        self.fee = np.array([[[(max(w, v) - 1) * size_penalty] for w in range(1, widths + 1)] for v in range(1, depths + 1)])
        self.times = np.arange(1.0, depths + 1)[:, None, None]
        self.in_paragraphs = source_paragraphs is not None or target_paragraphs is not None
        self.source_ok, self.target_ok = same_paragraph(source_paragraphs, n, widths), same_paragraph(target_paragraphs, m, depths)

    def start(self) -> list[np.ndarray]:
        """The sums before the first target, nearest first."""
        return [np.zeros(self.n + 1), *(np.full(self.n + 1, -np.inf) for _ in range(self.depths - 1))]

    def __call__(self, t: int, above: list[np.ndarray], end: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """For the first `end` sources: sums, the first cell of the band, and from it on each cell's rank and own score."""
        lo, hi = self.band(t)
        hi = min(hi, end)
        here = np.zeros(end + 1)
        if hi <= lo:
            return here, lo, np.zeros(0, np.int8), np.zeros(0)
        size, widths = hi - lo, self.widths
        scores = np.maximum(self.scores(t, lo, hi) - self.fee, 0.0)
        if self.least > 0:
            scores[scores < self.least] = 0.0
        # sums by depth, width and source: a window of w sources goes on from w places before; none goes on from before the start
        first = lo - widths + 1
        reached = np.full((self.depths, size + widths - 1), -np.inf)
        for v, row in enumerate(above):
            reached[v, max(-first, 0) :] = row[max(first, 0) : hi]
        step = reached.strides[1]
        before = np.lib.stride_tricks.as_strided(reached[:, widths - 1 :], (self.depths, widths, size), (reached.strides[0], -step, step))
        total = scores * self.times
        total += before
        if self.in_paragraphs:
            total[~(self.target_ok[:, t, None, None] & self.source_ok[None, :, lo:hi])] = -np.inf
        by_rank = total.reshape(self.depths * widths, size)[self.places]
        best, every = by_rank.argmax(axis=0), np.arange(size)
        sums, rank, own = by_rank[best, every], self.ranks[best], scores.reshape(self.depths * widths, size)[self.places[best], every]
        if self.skip == 0:
            # leaving one source out costs nothing, so it carries the best sum on; it goes before equally good windows
            run = np.maximum.accumulate(np.concatenate([[0.0], sums]))
            here[lo + 1 : hi + 1] = run[1:]
            out = run[:-1] >= sums
            rank[out], own[out] = 0, 0.0
            return here, lo, rank, own
        for i in range(size):
            s, x, k, y = lo + i, sums[i], rank[i], own[i]
            for r, w in self.alone:
                a = s - w + 1
                if a < 0 or not self.source_ok[w - 1, s]:
                    continue
                z = here[a] - self.skip if a else 0.0
                if z > x or (z == x and r < k):
                    x, k, y = z, r, 0.0
            here[s + 1], rank[i], own[i] = x, k, y
        return here, lo, rank, own


def align_rows(n: int, m: int, scores: RowScores, widths: int = 4, depths: int = 4, size_penalty: float = 0.03, skip_penalty: float = 0.0, least: float = 0.0,
               lead: int = 10, trail: float = 0.25, source_paragraphs: list[int] | None = None, target_paragraphs: list[int] | None = None, block: int | None = None) -> list[tuple[list[int], list[int], float, float]]:
    """The rows of `align`, target by target in memory that grows with n (times the logarithm of m).

    Only the sums of the last `depths` targets are kept on the way down. The way back needs each cell's choice: targets (if more
    than a block, of 64 or as many as make HELD cells) are cut in parts, at most `block`, the sums before each part are kept, and the parts are gone through again from the last to the first,
    themselves cut in parts until they have at most `block` targets, whose choices are held. Sources behind the
    way back are not visited again.
    """
    step = Recurrence(n, scores, widths, depths, size_penalty, skip_penalty, least, lead, trail, source_paragraphs, target_paragraphs, m)
    out: list[tuple[list[int], list[int], float, float]] = []
    block = max(64, HELD // n) if block is None else block
    s, t, over = n - 1, m - 1, False

    def alone() -> None:
        nonlocal over
        out.extend([([], [k], 0.0, 0.0) for k in range(t, -1, -1)] + [([k], [], 0.0, 0.0) for k in range(s, -1, -1)])
        over = True

    def back(first: int, last: int, above: list[np.ndarray]) -> None:
        """Continues the way back through the targets from first up to last. above: the sums of the targets before first, nearest first."""
        nonlocal s, t
        if over or t < first or s < 0:
            return
        end = s + 1
        if last - first > block:
            parts = min(block, -(-(last - first) // block))
            edges = [first + (last - first) * k // parts for k in range(parts + 1)]
            kept = {first: above}
            for u in range(first, edges[-2]):
                above = [step(u, above, end)[0], *above[: depths - 1]]
                if u + 1 in edges:
                    kept[u + 1] = above
            for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True):
                back(a, b, kept.pop(a))
            return
        held = []
        for u in range(first, min(last, t + 1)):
            held.append(step(u, above, end))
            above = [held[-1][0], *above[: depths - 1]]
        while not over and t >= first and s >= 0:
            sums, lo, rank, own = held[t - first]
            if not 0 <= s - lo < len(rank):
                alone()
                return
            w, v = step.windows[int(rank[s - lo])]
            out.append((list(range(s - w + 1, s + 1)), list(range(t - v + 1, t + 1)), float(sums[s + 1]), float(own[s - lo])))
            s, t = s - w, t - v

    back(0, m, step.start())
    if not over:
        alone()
    return out[::-1]


#: Rows of short chapters are passed on together, up to about so many.
ROWS = 1 << 13
ALIGNED = {"chapter_idx": pa.int64(), "row": pa.int64(), "source": pa.list_(pa.int64()), "target": pa.list_(pa.int64()), "score": pa.float64(), "own": pa.float64()}


def alignments(chapters: DataFrame, scores: Callable[[list[list[str]], list[list[str]]], RowScores], paragraphs: bool = False, known: Callable | None = None, **how: float) -> DataFrame:
    """chapters(chapter_idx, source, target: array<string>; with paragraphs also source_par, target_par: array<bigint>): chapter_idx,
    row, source, target (segment indices from 0), score (accumulated), own.

    A chapter is a row, so this is one narrow pass. scores gets both sides' lower-cased words; so does known, which may give the rows
    without scores, and is asked first.
    """
    columns = ["chapter_idx", "source", "target", *(["source_par", "target_par"] if paragraphs else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            for k in range(b.num_rows):
                key, source, target, *pars = (c[k].as_py() for c in b.columns)
                words = [[t.lower().split() for t in side or []] for side in (source, target)]
                more = dict(zip(("source_paragraphs", "target_paragraphs"), pars, strict=False))
                rows = known(*words, **how, **more) if known and all(words) else None
                if rows is None:
                    rows = align_rows(len(words[0]), len(words[1]), scores(*words), **how, **more) if all(words) else [([i], [], 0.0, 0.0) for i in range(len(words[0]))] + [([], [j], 0.0, 0.0) for j in range(len(words[1]))]
                held += [(key, i, *r) for i, r in enumerate(rows)]
                if len(held) >= ROWS or (held and k == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), ALIGNED.values(), strict=True)], list(ALIGNED))
                    held = []

    return chapters.select(*columns).mapInArrow(run, "chapter_idx bigint, row bigint, source array<bigint>, target array<bigint>, score double, own double")
