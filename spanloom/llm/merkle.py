"""Merkle manifest of a table: one digest for all rows, one for each group, and for each row the way up to them.

A row is a leaf: the digest of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value. Leaves of a group
stand in the order of the key; every FANOUT consecutive nodes (the last run: fewer, even one) become the digest of their
hex digests, until one is left, the group's subroot (of one row: its leaf). Subroots, in the order of their groups, likewise
give the root.

Leaves are dealt by range of (group, key), so a group spreads over as many tasks as it needs, and get their places from the
rows before them in their task and in the tasks before it. BLOCK consecutive leaves are one ordered array, whose levels are
collapsed by `sequence`, `transform`, `slice` and `aggregate`; the blocks' roots are the leaves of the next round, so that
rounds grow with the logarithm of the rows and no task holds more than a block. On the way down each block joins the
siblings above it and hands each of its nodes a path.

Texts are read once, in a narrow pass; what moves are digests. Defined cases: a null key comes first; rows that share a key
stand in the order of their leaves (equal leaves may change places without changing any digest), repeated rows each are a
leaf and give a row; a null group is a group, and the first; groups compare by their UTF-8 bytes; null and empty texts
differ (`-` and `0:`); other columns are ignored; an empty table gives no rows and so no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.runtime import buckets_for, discard, small_reads, written

FANOUT, LEVELS = 8, 3
#: Leaves of a block: LEVELS levels become one node.
BLOCK = FANOUT**LEVELS
#: Bytes of a leaf's row: digests of the row as it is and as it was changed, key and group.
ROW_BYTES = 200


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos (from 0, in this order within a group g) and n (the group's rows): no group is ever in one task."""
    parts = buckets_for(rows.sparkSession, rows.count() * ROW_BYTES)
    placed = written(rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()))
    # that id is the task's number above 33 bits, and below them the row's number in it
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs, group = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("c")), Window.partitionBy("g")
    runs = runs.select("g", "part", "first", (F.sum("c").over(group.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("n"))
    return placed.join(runs, ["g", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def collapsed(level: Column) -> Column:
    """The nodes above an array of nodes."""
    return F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / FANOUT).cast("int")), lambda j: digest(F.array_join(F.slice(level, j * FANOUT + 1, FANOUT), "")))


def widths(n: Column) -> Column:
    """Leaves below a node of each level that a block of a group of n nodes collapses: [1, 8, 64] or the first ones of it."""
    levels = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        levels = F.when(n <= FANOUT**k, k).otherwise(levels)
    return F.slice(F.array(*[F.lit(FANOUT**k) for k in range(LEVELS)]), 1, levels)


def blocks(nodes: DataFrame) -> DataFrame:
    """From (g, n, pos, node, more): g, n, block, members (in order, with what more there is), widths, levels (arrays of nodes, from the members' own up)."""
    more = [c for c in nodes.columns if c not in ("g", "n", "pos")]
    dealt = nodes.groupBy("g", "n", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *more))).alias("members"))
    dealt = dealt.withColumn("widths", widths(F.col("n")))
    own = F.array(F.transform("members", lambda m: m["node"]))
    return dealt.withColumn("levels", F.aggregate("widths", own, lambda levels, _: F.concat(levels, F.array(collapsed(F.element_at(levels, -1))))))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round, from the leaves up; in the last each group is one block."""
    most, tables = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        tables.append(written(blocks(nodes)))
        if most <= BLOCK:
            return tables
        most = -(-most // BLOCK)
        nodes = tops(tables[-1])


def tops(table: DataFrame) -> DataFrame:
    return table.select("g", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("node"))


def siblings(i: Column) -> Column:
    """For each level of a block what stands before and after the node above member i in its run."""

    def at(width: Column, k: Column) -> Column:
        place, level = (i / width).cast("int"), F.get("levels", k)
        before = place % FANOUT
        return F.struct(F.array_join(F.slice(level, place - before + 1, before), "").alias("before"), F.array_join(F.slice(level, place + 2, FANOUT - 1 - before), "").alias("after"))

    return F.transform("widths", at)


def descended(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The members of the lowest round with their paths. above: the path of each group's top node, and what else all of its rows get."""
    constant = [c for c in above.columns if c not in ("g", "path")]
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for table in reversed(tables):
        joined = table.join(above, ["g", "block"])
        found = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.concat(siblings(i), F.col("path")).alias("path")))
        below = joined.select("g", *constant, F.inline(found))
        above = below.select("g", F.col("m.pos").alias("block"), *constant, "path")
    return below


def proof_digest(path: Column) -> Column:
    """One digest for all siblings of a path, from the leaf up and from left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, p: digest(p["before"], node, p["after"]))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, changed_leaf, subroot, root and path (an array of before, after: siblings as concatenated hex digests, from the leaf up) for each row.

    changed: expressions over docs that take the place of fields in changed_leaf, to see whether a proof tells.
    """
    small_reads(docs.sparkSession)
    leaf = digest(*[field(docs[f]) for f in fields])
    other = digest(*[field((changed or {}).get(f, docs[f])) for f in fields])
    # groups as strings that are never null and order as asked; a number of its own keeps repeated rows apart when they are dealt
    named = docs.select(F.coalesce(F.concat(F.lit("1"), docs[group].cast("string")), F.lit("0")).alias("g"), docs[key].alias("k"), leaf.alias("node"), other.alias("changed"))
    leaves = written(named.withColumn("row", F.monotonically_increasing_id()), hashes=True)
    placed = numbered(leaves, "k", "node", "row").drop("row")
    rounds = climbed(placed)
    discard(leaves)
    discard(placed)
    subroots = tops(rounds[-1]).select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    ordered = numbered(subroots, "name")
    trunk = climbed(ordered)
    discard(ordered)
    root = tops(trunk[-1]).select("g", F.col("node").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    above = descended(trunk, root).select(F.col("m.name").alias("g"), F.col("m.node").alias("subroot"), "root", "path")
    return descended(rounds, above).select(F.col("m.k").alias(key), F.col("m.node").alias("leaf"), F.col("m.changed").alias("changed_leaf"), "subroot", "root", "path")


def manifest_sql(levels: int = 11, trunk: int = 4) -> str:
    """The rows of the registered query over documents as DuckDB SQL, for up to 8^levels documents in a language and 8^trunk languages."""
    enc = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leaf = lambda text: f"sha256({' || '.join(map(enc, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    step = "list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c // 2, (c % 2) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {step}), 4294967295)"
    runs = lambda table, out: f"{out} AS MATERIALIZED (SELECT g, pos, n, coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {table})"
    up = lambda table, out: f"{out} AS MATERIALIZED (SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {table} WHERE n > 1 GROUP BY g, pos // 8, n UNION ALL SELECT g, pos, n, node FROM {table} WHERE n = 1)"
    fold = "CASE WHEN s.n > 1 THEN sha256(lft || acc || rgt) ELSE acc END"
    parts = [
        f"c0 AS MATERIALIZED (SELECT *, {crc} AS crc FROM documents)",
        f"d0 AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS node, CASE WHEN crc % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS changed FROM c0)",
        "t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d0)",
        "f0 AS MATERIALIZED (SELECT doc_id, g, pos AS p, node AS leaf, changed AS acc, '' AS proof FROM t0)",
    ]
    for k in range(levels):
        parts += [runs(f"t{k}", f"s{k}"), up(f"t{k}", f"t{k + 1}")]
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT doc_id, f.g, p // 8 AS p, leaf, {fold} AS acc, proof || lft || rgt AS proof FROM f{k} f JOIN s{k} s ON s.g = f.g AND s.pos = p)")
    parts += [
        f"u0 AS MATERIALIZED (SELECT '' AS g, g AS name, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t{levels})",
        f"h0 AS MATERIALIZED (SELECT f.*, u.node AS subroot, u.pos AS q FROM f{levels} f JOIN u0 u ON u.name = f.g)",
    ]
    for k in range(trunk):
        parts += [runs(f"u{k}", f"v{k}"), up(f"u{k}", f"u{k + 1}")]
        parts.append(f"h{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, q // 8 AS q, {fold} AS acc, proof || lft || rgt AS proof FROM h{k} h JOIN v{k} s ON s.pos = q)")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = node AS verified FROM h{trunk}, u{trunk}"
