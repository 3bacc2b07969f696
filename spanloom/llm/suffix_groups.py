"""Suffix arrays by linear grouping.

Suffixes start out grouped by first symbol. Groups are processed from the greatest to the least. When a group's
turn comes its common prefix is final (a Lyndon word), and each member links to the nearest suffix before it in
a smaller group. A suffix that k members link to continues with k copies of the group's word, so it leaves its
own group for a new one just above it, the greater the k the higher. After that every suffix stands with the
suffixes that share its longest Lyndon prefix, and the groups are in order. A second pass walks the sorted
suffixes from the least and puts each one's predecessors, along the same links, into the next free place of
their groups. Nothing is renamed and no reduced text is sorted.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[list[int]], list[int], list[int]]:
    """Group numbers in ascending order, members by group number, each suffix's group, and each suffix's
    nearest suffix before it in a smaller group (-1: none)."""
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in members:
            members[c].append(i)
        else:
            members[c] = [i]
    symbols = sorted(members)
    number = {c: k for k, c in enumerate(symbols)}
    group = [members[c] for c in symbols]  # some of the members may have left: see home
    home = [number[c] for c in text]
    lower, higher = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    before = [-1] * len(text)
    done = bytearray(len(text))
    order = []
    g = len(symbols) - 1
    while g >= 0:
        mine = [i for i in group[g] if home[i] == g]
        if mine:
            group[g] = mine  # in the order of the text, as members always are: see below
            order.append(g)
            links: dict[int, int] = {}
            for i in mine:
                done[i] = 1
                j = i - 1
                while j >= 0 and done[j]:
                    j = before[j]
                if j >= 0:
                    before[i] = j
                    links[j] = links.get(j, 0) + 1
            # A link is the last suffix before i that is not done, so links come in the order of the text. They are dealt by how
            # many members link to them: in ascending counts each home's new group goes right above the one before it.
            by_count: list[list[int]] = [[] for _ in range(max(links.values(), default=0) + 1)]
            for j, k in links.items():
                by_count[k].append(j)
            top: dict[int, int] = {}  # by home
            for some in by_count:
                opened: dict[int, int] = {}
                for j in some:
                    h = home[j]
                    if (new := opened.get(h)) is None:
                        at = top.get(h, h)
                        new, up = len(group), higher[at]
                        group.append([])
                        lower.append(at)
                        higher.append(up)
                        higher[at] = lower[up] = opened[h] = new
                    group[new].append(j)
                    home[j] = new
                top.update(opened)
        g = lower[g]
    order.reverse()
    return order, group, home, before


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers, in ascending order."""
    n = len(text)
    if not n:
        return []
    order, group, home, before = lyndon_groups(text)
    free, at = {}, 0
    for g in order:
        free[g] = at
        at += len(group[g])
    out, placed = [0] * n, bytearray(n)

    def follow(j: int) -> None:
        while j >= 0 and not placed[j]:
            h = home[j]
            k = free[h]
            out[k] = j
            free[h] = k + 1
            placed[j] = 1
            j = before[j]

    follow(n - 1)  # the empty suffix comes first
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            h = home[j]
            f = free[h]
            out[f] = j
            free[h] = f + 1
            placed[j] = 1
            j = before[j]
    return out
