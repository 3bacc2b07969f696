"""Longest common token spans of an aligned row, longest first, each character used once.

The long side's tokens, read backwards, make a suffix automaton: its states stand for token runs that begin at the same places.
One walk over the short side, backwards too, gives for each of its tokens the longest run from there that the long
side has. These are events in a heap, longest first, then leftmost; an event that no free place serves any more comes back
shorter, along the automaton's links. So memory grows with both lengths, not with their product.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np

from spanloom.functions.text import TOKEN

_TOKEN = re.compile(TOKEN)
#: States with more places look at them all at once.
MANY = 48


def placed_tokens(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased tokens without the blank before them, with their offsets."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group().lstrip()
        out.append((word.lower(), m.end() - len(word), m.end()))
    return out


def within_one(segments: list[str], start: int, end: int) -> bool:
    """Whether a span lies within one of the segments that make up a text."""
    ends = list(accumulate(map(len, segments)))
    k = bisect_right(ends, start)
    return k < len(ends) and end <= ends[k]


class Places:
    """A suffix automaton of a token sequence read backwards, and which of its places are still free."""

    def __init__(self, tokens: list[str]):
        self.n = len(tokens)
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, first = [-1], [0], [-1]
        last = 0
        for place in range(self.n - 1, -1, -1):
            last = self._extend(last, tokens[place], place, first)
        self._order(first)
        #: Free tokens from each place on.
        self.free = list(range(self.n, 0, -1))
        self.free_array = np.array(self.free, np.int64)
        self.used: list[tuple[int, int]] = []

    def _state(self, size: int, place: int, first: list[int]) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        first.append(place)
        return len(self.size) - 1

    def _extend(self, last: int, token: str, place: int, first: list[int]) -> int:
        new = self._state(self.size[last] + 1, place, first)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][token]
        if self.size[q] == self.size[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.size[p] + 1, -1, first)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def _order(self, first: list[int]) -> None:
        """Lists all places such that those of a state stand side by side: states in the order of a walk down the links."""
        below: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            below[self.link[state]].append(state)
        self.places: list[int] = []
        self.begin, self.end = [0] * len(self.link), [0] * len(self.link)
        todo = [(0, False)]
        while todo:
            state, left = todo.pop()
            if left:
                self.end[state] = len(self.places)
                continue
            self.begin[state] = len(self.places)
            if first[state] >= 0:
                self.places.append(first[state])
            todo.append((state, True))
            todo += [(b, False) for b in below[state]]
        self.places_array = np.array(self.places, np.int64)

    def step(self, state: int, length: int, token: str) -> tuple[int, int]:
        """The state and length of the longest run that begins with the token and goes on as a run of this state."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        following = self.next[state].get(token)
        return (following, length + 1) if following is not None else (0, 0)

    def at_length(self, state: int, length: int) -> int:
        """The state of a state's runs cut to a length."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def first_free(self, state: int, length: int) -> tuple[int | None, int]:
        """The first place where so many tokens are free; if there is none, the length at which there may be one (0: nowhere)."""
        i, j = self.begin[state], self.end[state]
        if j - i > MANY:
            places = self.places_array[i:j]
            free = self.free_array[places]
            if (ok := free >= length).any():
                return int(places[ok].min()), length
            most = int(free.max())
        else:
            found, most = None, 0
            for p in self.places[i:j]:
                f = self.free[p]
                if f >= length:
                    found = p if found is None or p < found else found
                elif f > most:
                    most = f
            if found is not None:
                return found, length
        return None, max(most, self.size[self.link[state]])

    def use(self, place: int, length: int) -> None:
        """Tokens from a place on are used; the free stretch before them ends there."""
        k = bisect_left(self.used, (place, 0))
        begin = self.used[k - 1][1] if k else 0
        self.used.insert(k, (place, place + length))
        self.free[begin:place] = range(place - begin, 0, -1)
        self.free[place : place + length] = [0] * length
        self.free_array[begin : place + length] = self.free[begin : place + length]

    def find(self, tokens: list[str]) -> int | None:
        """The first free place of a whole sequence."""
        state = 0
        for t in reversed(tokens):
            if (state := self.next[state].get(t)) is None:
                return None
        return self.first_free(state, len(tokens))[0]


def reaches(tokens: list[tuple[str, int, int]], segments: list[str]) -> list[int]:
    """How many tokens from each one on lie within the segment in which it starts."""
    ends = list(accumulate(map(len, segments)))
    last = [t[2] for t in tokens]
    return [max(bisect_right(last, ends[k]) - i, 0) if (k := bisect_right(ends, start)) < len(ends) else 0 for i, (_, start, _) in enumerate(tokens)]


def common_spans(original: list[str], abridged: list[str]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(original span, abridged span) pairs by abridged start; an abridged span lies within one segment."""
    long, short = placed_tokens("".join(original)), placed_tokens("".join(abridged))
    if not long or not short:
        return []
    places, most = Places([t[0] for t in long]), reaches(short, abridged)
    at, events, state, length = [0] * len(short), [], 0, 0
    for i in range(len(short) - 1, -1, -1):
        state, length = places.step(state, length, short[i][0])
        at[i] = state
        if n := min(length, most[i]):
            events.append((-n, i))
    heapq.heapify(events)
    used, ends, out = [False] * len(short), [], []  # ends: of the used runs of short tokens, as (first, end)
    while events:
        n, i = heapq.heappop(events)
        n = -n
        if used[i]:
            continue
        k = bisect_left(ends, (i, 0))
        if k < len(ends) and ends[k][0] < i + n:  # the next used run is nearer now
            heapq.heappush(events, (i - ends[k][0], i))
            continue
        at[i] = places.at_length(at[i], n)
        place, rest = places.first_free(at[i], n)
        if place is None:
            if rest:
                heapq.heappush(events, (-rest, i))
            continue
        out.append(((long[place][1], long[place + n - 1][2]), (short[i][1], short[i + n - 1][2])))
        places.use(place, n)
        used[i : i + n] = [True] * n
        ends.insert(k, (i, i + n))
    return sorted(out, key=lambda pair: pair[1][0])
