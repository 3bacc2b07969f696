"""Monotone alignment by union recall where every target can be paid in full, as when a text is shortened by leaving segments out.

No path can have more than its targets are worth in the best windows, whatever the sources. If a path reaches that bound, it is made of windows that
hold all of their target tokens and lose nothing to size, and so is each path as good as it. Those windows are few and are found by their rarest word;
among them the recurrence, its ties and its way back are those of `monotone.align`. Where no path reaches the bound, or the search would not be small,
there is no answer, and all windows have to be scored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from heapq import merge

from spanloom.operators.monotone import band, mark_bits

#: What a sum may lack by rounding. A token more or less in a window counts for more, up to MOST tokens.
SLACK, MOST = 2e-6, 100_000


def in_order(part: list[str], whole: list[str]) -> bool:
    left = iter(whole)
    return all(token in left for token in part)


def holds(source: list[list[str]], target: list[list[str]]) -> bool:
    """Whether `monotone.union_recall` is 1: each token on a common subsequence, with a copy of its own."""
    if len(source) == 1 and len(target) == 1:
        return in_order(target[0], source[0])
    if Counter(t for x in target for t in x) - Counter(t for x in source for t in x):
        return False
    for sentence in target:
        if any(in_order(sentence, x) for x in source):
            continue
        marks = 0
        for x in source:
            places: dict[str, int] = {}
            for i, token in enumerate(x):
                places[token] = places.get(token, 0) | 1 << i
            marks |= mark_bits(sentence, places, len(x))
        if marks != (1 << len(sentence)) - 1:
            return False
    return True


def perfect_rows(source: list[list[str]], target: list[list[str]], size_penalty: float = 0.03, lead: int = 10, trail: float = 0.25, widths: int = 4, depths: int = 4) -> list[tuple[list[int], list[int], float, float]] | None:
    """The rows of `monotone.align` with `monotone.union_recall`, or None if they are not known to be these."""
    n, m = len(source), len(target)
    upto = [0]
    for x in target:
        upto.append(upto[-1] + len(x))
    if not n or not m or upto[m] > MOST:
        return None
    own = [[max(0.0, 1.0 - (max(w, v) - 1) * size_penalty) for v in range(depths + 1)] for w in range(widths + 1)]
    # what the targets before and behind a place are worth at best
    head, tail = [0.0] * (m + 1), [0.0] * (m + 1)
    for t in range(1, m + 1):
        head[t] = max(head[t - 1], *(head[t - v] + v * own[1][v] for v in range(1, min(depths, t) + 1) if upto[t] > upto[t - v]), 0.0)
    for t in range(m - 1, -1, -1):
        tail[t] = max(tail[t + 1], *(tail[t + v] + v * own[1][v] for v in range(1, min(depths, m - t) + 1) if upto[t + v] > upto[t]), 0.0)
    least = head[m] - SLACK
    where: dict[str, list[int]] = {}
    for s, x in enumerate(source):
        for token in set(x):
            where.setdefault(token, []).append(s)
    order = {wv: k for k, wv in enumerate(sorted(((w, v) for w in range(1, widths + 1) for v in range(depths + 1)), key=sum))}
    bands = [band(t, n, lead, trail) for t in range(m)]
    #: For each target the sources at which its best sum grows, that sum, and the window that ends there.
    ends: list[list[int]] = []
    sums: list[list[float]] = []
    windows: list[list[tuple[int, int]]] = []

    def best(s: int, t: int) -> float:
        if s < 0 or t < 0 or not bands[t][0] <= s < bands[t][1]:
            return 0.0
        k = bisect_right(ends[t], s) - 1
        return sums[t][k] if k >= 0 else 0.0

    left = n * m // 4 + 4096  # tries, so that a search that is not small ends
    for t in range(m):
        lo, hi = bands[t]
        ends.append([])
        sums.append([])
        windows.append([])
        # what the row can reach, to the last digit: sums before it grow with the sources
        most, tries = 0.0, []
        for v in range(1, min(depths, t + 1) + 1):
            b = t + 1 - v
            if upto[t + 1] == upto[b]:
                if head[b] + tail[t + 1] >= least:
                    return None  # nothing is lost by targets without tokens, so they may end anywhere
                continue
            wide = [w for w in range(1, widths + 1) if head[b] + v * own[w][v] + tail[t + 1] >= least]
            if not wide:
                continue
            most = max(most, own[wide[0]][v] * v + (sums[b - 1][-1] if b and sums[b - 1] else 0.0))
            rarest = min((where.get(token, []) for x in target[b : t + 1] for token in x), key=len)
            near = rarest[bisect_left(rarest, lo - widths) : bisect_left(rarest, hi)]
            for w in wide:
                at = near if w == 1 else sorted({s for o in near for s in range(max(o, w - 1), o + w)})
                tries.append([(s, order[w, v], w, v) for s in at if lo <= s < hi])
        now, at = 0.0, -1
        for s, _, w, v in tries[0] if len(tries) == 1 else merge(*tries):
            if now >= most and s > at:
                break
            left -= 1
            total = own[w][v] * v + best(s - w, t - v)
            if total > now and total + tail[t + 1] >= least and holds(source[s - w + 1 : s + 1], target[t - v + 1 : t + 1]):
                if s == at:  # a better one that ends there
                    ends[t].pop(), sums[t].pop(), windows[t].pop()
                now, at = total, s
                ends[t].append(s)
                sums[t].append(total)
                windows[t].append((w, v))
        if left < 0:
            return None
    if best(n - 1, m - 1) < least + SLACK / 2:
        return None
    out, s, t = [], n - 1, m - 1
    while s >= 0 and t >= 0:
        k = bisect_right(ends[t], s) - 1
        if k < 0 or not bands[t][0] <= s < bands[t][1]:
            return None
        if ends[t][k] == s:
            w, v = windows[t][k]
            out.append((list(range(s - w + 1, s + 1)), list(range(t - v + 1, t + 1)), sums[t][k], own[w][v]))
            s, t = s - w, t - v
        else:
            out.append(([s], [], sums[t][k], 0.0))
            s -= 1
    out += [([], [k], 0.0, 0.0) for k in range(t, -1, -1)] + [([k], [], 0.0, 0.0) for k in range(s, -1, -1)]
    return out[::-1]
