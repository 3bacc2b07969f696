"""Fill-in-middle transformation: texts cut in three, written in an order that asks for the middle last.

A unit is a word with the blanks before it, or the blanks that end a text. One automaton (Aho and Corasick's) runs over the
characters of a text and meets the six ASCII blanks, at which the class of characters changes, and the three sentinels. These
events are all that is kept: a gap between two of them holds a word, so counting the gaps that are not empty numbers
the units, and the end of the r-th unit is the event after the r-th such gap. A text with a sentinel of its own stays plain.

The cuts and the form follow from a hash of the seed and the key, so they are alike on every run and machine. One narrow
pass, no shuffle. Defined cases: null and empty texts have no units and stay plain; a null key hashes as if it had no
digits; repeated rows each give a row, and rows that share a key share its hash; other columns are ignored; an empty table gives
no rows. Memory follows one Arrow batch and, in a text, its blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.runtime import small_batches

BLANKS = "\t\n\v\f\r "
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def automaton() -> ahocorasick.Automaton:
    """Of blanks (value 0) and sentinels (value 1)."""
    events = ahocorasick.Automaton()
    for blank in BLANKS:
        events.add_word(blank, 0)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        events.add_word(sentinel, 1)
    events.make_automaton()
    return events


class Units:
    """The unit ends of one text, from its events."""

    def __init__(self, text: str, events: ahocorasick.Automaton):
        found = np.fromiter((2 * end + is_sentinel for end, is_sentinel in events.iter(text)), np.int64)
        sentinel = (found & 1).astype(bool)
        self.has_sentinel = bool(sentinel.any())
        blanks = found[~sentinel] >> 1
        edges = np.concatenate([[-1], blanks, [len(text)]])
        self.ends = edges[1:][np.diff(edges) > 1]  # where the words end
        self.length = len(text)
        self.n = len(self.ends) + (len(blanks) > 0 and blanks[-1] == len(text) - 1)

    def end(self, units: int) -> int:
        """Characters that the first so many units have."""
        if units == 0:
            return 0
        return int(self.ends[units - 1]) if units <= len(self.ends) else self.length


def hashes(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and key, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output per row.

    share: of 100 texts so many are cut, and spm_share of 100 of these have their suffix first.
    """
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    drawn = docs.select(docs[key].alias("id"), docs[text].alias("t"), *[h.alias(f"h{i}") for i, h in enumerate(hashes(docs[key], seed))])

    def cut(t: str, events: ahocorasick.Automaton, h1: int, h2: int, h3: int, h4: int) -> tuple:
        units = Units(t, events)
        if not t or units.has_sentinel or h3 % 100 >= share:
            return units.n, PLAIN, None, None, t
        low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
        a, b = units.end(low), units.end(high)
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        if h4 % 100 < spm_share:
            return units.n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return units.n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events, names = automaton(), ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for b in batches:
            h = [c.to_numpy().tolist() for c in b.columns[2:]]
            rows = [cut(t.as_py() or "", events, *x) for t, *x in zip(b.column(1), *h, strict=True)]
            n, form, prefix, middle, out = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names)

    made = drawn.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", key)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: neither part of a cut text holds a sentinel, nor can one arise where two meet."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, last = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == PSM, F.concat(first, last, second)).when(form == SPM, F.concat(second, last, first)).otherwise(output)


def middles_sql(seed: int = 42, share: int = 50, spm_share: int = 80) -> str:
    """The rows of the registered query over documents as DuckDB SQL: units as a list of matches, parts as slices of it."""
    blank = r"\x20\x09-\x0D"
    number = lambda i: f"CAST('0x' || substr(digits, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}"
    cut = lambda at: f"{at}(h1 % (n + 1), h2 % (n + 1))"
    own = " OR ".join(f"contains(text, '{x}')" for x in (PREFIX, SUFFIX, MIDDLE))
    joined = lambda a, b, name: f"array_to_string(units[{a}:{b}], '') AS {name}"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits, regexp_extract_all(coalesce(text, ''), '[{blank}]*[^{blank}]+|[{blank}]+') AS units FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, {', '.join(map(number, range(4)))} FROM t),
c AS (SELECT *, CASE WHEN text = '' OR {own} OR h3 % 100 >= {share} THEN '{PLAIN}' WHEN h4 % 100 < {spm_share} THEN '{SPM}' ELSE '{PSM}' END AS form, {cut('least')} AS low, {cut('greatest')} AS high FROM h),
p AS (SELECT *, {joined(1, 'low', 'prefix')}, {joined('low + 1', 'high', 'middle')}, {joined('high + 1', 'n', 'suffix')} FROM c),
o AS (SELECT *, CASE form WHEN '{PLAIN}' THEN text WHEN '{PSM}' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM p),
b AS (SELECT *, string_split_regex(output, '{PREFIX}|{SUFFIX}|{MIDDLE}') AS x FROM o)
SELECT doc_id, n, form, CASE WHEN form <> '{PLAIN}' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> '{PLAIN}' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
sha256(CASE form WHEN '{PLAIN}' THEN output WHEN '{PSM}' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM b"""
