"""Text functions as Column expressions: normalisation, numbers, titles, segmentation, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentences that tile a paragraph: up to a run of end marks with the blanks behind it, or the unfinished rest.
SENTENCE = "[^.!?]*[.!?]+\\s*|[^.!?]+"
#: Tokens with at most one blank before them.
TOKEN = "\\s?[A-Za-z0-9]+|\\s?[^A-Za-z0-9\\s]"
WORD = "[a-z0-9]+"
# Code points read as a hyphen.
DASHES = (0x002D, 0x058A, 0x05BE, 0x1400, 0x1806, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2E17, 0x2E1A, 0x2E3A, 0x2E3B, 0x2E40, 0x301C, 0x3030, 0x30A0, 0xFE31, 0xFE32, 0xFE58, 0xFE63, 0xFF0D)
# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 10**2, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
# Words with a full stop that do not end a sentence (those with a space in them never match a token).
ABBREVIATIONS = (
    "a.d.", "a.m.", "anon.", "ave.", "b.c.", "blvd.", "br.", "c.", "ca.", "cf.", "cg.", "ct.", "def.", "dr.", "drs.", "e.", "e.g.", "et al.", "et seq.", "etc.", "fr.", "ft.",
    "hon.", "hr.", "ibid.", "id.", "inc.", "i.e.", "illus.", "jr.", "kg.", "km.", "lb.", "ln.", "m.", "messrs.", "min.", "ml.", "mmes.", "mph.", "mr.", "mrs.", "ms.", "mss.", "mt.",
    "n.", "n.b.", "n.e.", "n.w.", "oz.", "p.", "pg.", "p.m.", "pp.", "pr.", "prof.", "p.s.", "pseud.", "ps.", "pt.", "pub.", "q.v.", "rd.", "rev.", "rte.",
    "s.", "sc.", "s.e.", "sec.", "sen.", "sr.", "st.", "s.w.", "s.v.", "trans.", "viz.", "vol.", "v.", "vs.", "w.",
)


def ascii_text(text: Column) -> Column:
    """Curly quotes and dashes to ASCII; all that is left beyond ASCII goes."""
    plain = F.translate(text, "‘’“”", "''\"\"")
    plain = F.translate(plain, "".join(map(chr, DASHES)), "-" * len(DASHES))
    return F.regexp_replace(plain, "[^\\x00-\\x7F]", "")


def blank_line_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, with the line breaks inside them as spaces."""
    return F.transform(F.split(F.regexp_replace(text, "\n{3,}", "\n\n"), "\n\n"), lambda p: F.regexp_replace(p, "\n+", " "))


def squeezed(text: Column) -> Column:
    """Runs of two or more blanks become one space; blanks at the ends go."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "^\\s+|\\s+$", "")


def lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def number_words(text: Column) -> Column:
    """The number that English number words name; null if a word is not one."""
    small = {w: i for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
    words = F.filter(F.split(F.translate(F.lower(text), "-", " "), " +"), lambda w: (w != "and") & (w != ""))
    start = F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("done"))

    def step(acc: Column, w: Column) -> Column:
        scale, value = lookup(SCALES)[w], lookup(small)[w]
        times = F.greatest(acc["now"], F.lit(1)) * scale
        now = F.when(scale.isNull(), acc["now"] + value).when(scale > 100, F.lit(0)).otherwise(times)
        done = F.when(scale > 100, acc["done"] + times).otherwise(acc["done"])
        return F.struct(now.cast("bigint").alias("now"), done.cast("bigint").alias("done"))

    return F.aggregate(words, start, step, lambda acc: acc["now"] + acc["done"])


def roman_number(text: Column) -> Column:
    """A numeral that stands before a greater one is taken off, others add up."""
    values = F.transform(F.regexp_extract_all(F.upper(text), F.lit("[A-Z]"), F.lit(0)), lambda c: lookup(ROMAN)[c])
    signed = F.transform(values, lambda v, i: F.when(F.get(values, i + 1) > v, -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v).cast("bigint")


def title_text(book: Column, book_title: Column, chapter: Column, title: Column) -> Column:
    """Book n - title | Chapter m: t, with what is missing left out."""
    first = F.when(book.isNotNull(), F.concat(F.lit("Book "), book.cast("string"), F.when(book_title.isNotNull(), F.concat(F.lit(" - "), book_title)).otherwise("")))
    second = F.concat(F.lit("Chapter "), chapter.cast("string"), F.when(title.isNotNull(), F.concat(F.lit(": "), title)).otherwise(""))
    return F.concat_ws(" | ", first, second)


def paragraph_texts(text: Column) -> Column:
    """Paragraphs; all but the last keep their line break. One split, behind the breaks."""
    return F.split(text, "(?<=\n)", -1)


def sentence_texts(paragraph: Column) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0))


def ends_in_abbreviation(segment: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(segment, "\\s+$", ""), " "), -1)).isin(*ABBREVIATIONS)


def only_punctuation(segment: Column) -> Column:
    return F.regexp_replace(segment, "\\s+$", "").rlike("^[!-/:-@\\[-`{-~]*$")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def shown(text: Column, most: int = 1000) -> Column:
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise(""))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with offsets from 0."""
    return F.substring(text, start + 1, end - start)


def first_numbers(cell: Column) -> Column:
    """The segment numbers of a review sheet's cell: one [n] per line, as the rest of the line belongs to it."""
    return F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit("\\[([0-9]+)\\](.*)"), F.lit(1)), lambda x: x.cast("bigint"))


def padded_labels(gold: Column, predicted: Column) -> Column:
    """Predictions filled up with 0 to the gold length."""
    return F.concat(predicted, F.array_repeat(F.lit(0), F.size(gold) - F.size(predicted)))


def ngrams(items: Column, n: int) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, every).otherwise(F.array().cast("array<string>"))


def f_score(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
