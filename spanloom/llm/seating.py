"""Gibbs sampling of Chinese-restaurant seatings, vectorised over many dishes.

A dish has customers at tables of its own; sizes of all tables stand one after the other, dish by dish. A move takes one
customer from its table and seats it again given where the others sit: at a table of k customers with weight
k - discount, at a new one with the dish's weight of opening. A sweep moves every customer of every dish: one after the
other in a dish with up to SINGLY customers, all together in a larger one (the same stationary distribution). A dish with one
customer has one table whatever is drawn.
"""

from __future__ import annotations

import numpy as np

#: Customers of a dish that are moved one by one at most; of larger dishes all are moved together.
SINGLY = 64


def offsets_of(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each group of n."""
    return np.arange(int(n.sum())) - np.repeat(offsets_of(n), n)


def swept(customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish, and their sizes, after a sweep."""
    t, parts, whose = tables.copy(), [], []
    owner = np.repeat(np.arange(len(customers)), tables)
    for pick, move in ((customers < 2, None), ((customers >= 2) & (customers <= SINGLY), small), (customers > SINGLY, large)):
        dishes, mine = np.flatnonzero(pick), sizes[pick[owner]]
        if move is not None and len(dishes):
            # larger dishes first, so that those that still move are the first ones
            order = np.argsort(-customers[dishes], kind="stable")
            number = tables[dishes]
            at = offsets_of(number)[order]
            mine = mine[np.repeat(at, number[order]) + within(number[order])]
            dishes = dishes[order]
            t[dishes], mine = move(customers[dishes], tables[dishes].copy(), mine, weight[dishes], discount, rng)
        parts.append(mine)
        whose.append(np.repeat(dishes, t[dishes]))
    order = np.argsort(np.concatenate(whose), kind="stable")
    return t, np.concatenate(parts)[order]


def small(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, w: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All customers in turn; each knows its table."""
    o, total = offsets_of(c), int(c.sum())
    slot = np.repeat(o, t) + within(t)
    size = np.zeros(total, np.int64)
    size[slot] = sizes
    # a customer's table, by number within its dish; in random order, as the turn must not depend on the tables
    seat = np.repeat(within(t), sizes)[np.argsort(np.repeat(np.arange(len(c)), c) + rng.random(total))]
    free = within(c)  # a stack of unused table numbers behind the used ones of each dish
    used = t.copy()  # of the stack: where the free numbers begin
    for j in range(int(c[0])):
        n = int(np.searchsorted(-c, -j, "left"))  # dishes with more than j customers
        at, first = o[:n] + j, o[:n]
        table = first + seat[at]
        size[table] -= 1
        empty = np.flatnonzero(size[table] == 0)
        used[empty] -= 1
        free[first[empty] + used[empty]] = seat[at[empty]]
        opens = rng.random(n) * (w[:n] + c[:n] - 1 - d * used[:n]) < w[:n]
        new = np.flatnonzero(opens)
        seat[at[new]] = free[first[new] + used[new]]
        used[new] += 1
        size[first[new] + seat[at[new]]] = 1
        wait = np.flatnonzero(~opens)
        while len(wait):  # the table of another customer, kept with its share of (size - discount) / size
            other = (rng.random(len(wait)) * (c[wait] - 1)).astype(np.int64)
            other += other >= j
            number = seat[first[wait] + other]
            there = size[first[wait] + number]
            fine = rng.random(len(wait)) * there < there - d
            done = wait[fine]
            seat[at[done]] = number[fine]
            size[first[done] + number[fine]] += 1
            wait = wait[~fine]
    return used, size[size > 0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight places further up."""
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def new_tables(x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes n drawn with weight (1 - d)(2 - d)...(n - 1 - d) x^n / n!."""
    n, p, left = np.ones(len(x), np.int64), d * x / -np.expm1(d * np.log1p(-x)), rng.random(len(x))
    at = np.arange(len(x))
    while len(at):
        left[at] -= p[at]
        at = at[(left[at] >= 0) & (p[at] > 1e-18)]  # beyond that only rounding is left
        p[at] *= x[at] * (n[at] - d) / (n[at] + 1)
        n[at] += 1
    return n


def shared_out(n: np.ndarray, t: np.ndarray, weight: np.ndarray, rng: np.random.Generator, cells: int = 1 << 20) -> np.ndarray:
    """How many of each dish's n customers each of its t tables gets, by weight."""
    o, out = offsets_of(t), np.zeros(len(weight), np.int64)
    width = 1 << np.ceil(np.log2(t)).astype(np.int64)
    for k in np.unique(width).tolist():
        same = np.flatnonzero(width == k)
        for i in range(0, len(same), step := max(1, cells // k)):
            mine = same[i : i + step]
            at = o[mine, None] + t[mine, None] - k + np.arange(k)  # a dish's own tables are its row's last cells
            own = at >= o[mine, None]
            share = np.where(own, weight[np.maximum(at, 0)], 0)
            out[at[own]] = rng.multinomial(n[mine], share / share.sum(axis=1, keepdims=True))[own]
    return out


def large(c: np.ndarray, t: np.ndarray, sizes: np.ndarray, w: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A random half of the customers together, given where the others sit; then these. The cost is that of the tables."""
    dish, held = np.repeat(np.arange(len(c)), t), rng.binomial(sizes, 0.5)
    alone = np.flatnonzero(np.bincount(dish, held, len(c)) == 0)
    held[offsets_of(t)[alone]] = 1
    for _ in range(2):
        dish, held = dish[held > 0], held[held > 0]
        joined, size, whose = together(c - np.bincount(dish, held, len(c)).astype(np.int64), np.bincount(dish, minlength=len(c)), held, w, d, rng)
        dish = np.concatenate([dish, whose])
        order = np.argsort(dish, kind="stable")
        dish, sizes, held = dish[order], np.concatenate([held + joined, size])[order], np.concatenate([joined, size])[order]
        if (np.bincount(dish, held, len(c)) == 0).any():  # all were held: nothing to hold them by
            break
    return np.bincount(dish, minlength=len(c)), sizes


def together(n: np.ndarray, t: np.ndarray, held: np.ndarray, w: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seats n customers a dish where others sit at t tables: how many join each table, sizes of new tables and their dishes.

    If the tables hold f customers and a = f - d t, then j customers join them with weight Gamma(a + j) / j!, dealt to tables
    by shares that are Dirichlet of held - d; the others sit at new tables, of weight w (1 - d)...(size - 1 - d) / size! each.
    With both sides times x^customers, the new tables are Poisson many of independent sizes, kept with a probability in
    proportion to the weight of the j that they leave. Any x is exact; where all are n in the mean, most are kept.
    """
    every = np.arange(len(n))
    a, low, high = np.bincount(np.repeat(every, t), held, len(n)) - d * t, np.zeros(len(n)), np.ones(len(n))
    for _ in range(30):
        x = (low + high) / 2
        few = a * x / (1 - x) + w * x * (1 - x) ** (d - 1) < n
        low, high = np.where(few, x, low), np.where(few, high, x)
    x = (low + high) / 2
    rate = w / d * -np.expm1(d * np.log1p(-x))

    def log_weight(j: np.ndarray, at: np.ndarray) -> np.ndarray:
        return log_gamma(a[at] + j) - log_gamma(j + 1.0) + j * np.log(x[at])

    most = log_weight(np.floor(np.maximum(a - 1, 0) * x / (1 - x)), every)
    stay, found, whose, wait = n.copy(), [], [], every
    while len(wait):
        who = np.repeat(np.arange(len(wait)), rng.poisson(rate[wait]))
        size = new_tables(x[wait[who]], d, rng)
        j = n[wait] - np.bincount(who, size, len(wait)).astype(np.int64)
        fine = (j >= 0) & (np.log(rng.random(len(wait))) < log_weight(np.maximum(j, 0), wait) - most[wait])
        stay[wait[fine]] = j[fine]
        found.append(size[fine[who]])
        whose.append(wait[who[fine[who]]])
        wait = wait[~fine]
    none = np.zeros(0, np.int64)
    return shared_out(stay, t, rng.standard_gamma(held - d), rng), np.concatenate([none, *found]), np.concatenate([none, *whose])


def adjusted(before: np.ndarray, tables: np.ndarray, sizes: np.ndarray, after: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seats once a dish has `after` customers where it had `before`: (tables, sizes) in swept's order.

    Customers drawn at random leave; those that come sit down with one drawn at random, until the next sweep moves them.
    """
    changed = before != after
    if not changed.any():
        return tables, sizes
    owner = np.repeat(np.arange(len(tables)), tables)
    moving = changed[owner]
    dish = np.repeat(owner[moving], sizes[moving])
    table = np.repeat(np.arange(len(sizes))[moving], sizes[moving])
    order = np.lexsort((rng.random(len(dish)), dish))  # each dish's customers in random order
    table, rank = table[order], within(before[changed])
    stay = table[rank < np.repeat(after[changed], before[changed])]
    more = np.maximum(after - before, 0)[changed]
    drawn = np.repeat(offsets_of(before[changed]), more) + (rng.random(int(more.sum())) * np.repeat(before[changed], more)).astype(np.int64)
    new = np.bincount(np.concatenate([stay, table[drawn]]), minlength=len(sizes))
    sizes = np.where(moving, new, sizes)
    left = np.bincount(owner[sizes > 0], minlength=len(tables))
    return left, sizes[sizes > 0]
