"""Multiset token comparison, alignment scores, agreement: DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx


def token_ids(texts: DataFrame, keys: list[str], text: str, name: str = "token") -> DataFrame:
    """keys, token, k: each word with how often it stood before (from 0), so multisets compare as sets."""
    words = texts.select(*keys, F.posexplode(tx.words(F.col(text))).alias("pos", name))
    return words.select(*keys, name, (F.row_number().over(Window.partitionBy(*keys, name).orderBy("pos")) - 1).cast("bigint").alias("k"))


def counted(texts: DataFrame, keys: list[str], text: str, count: str) -> DataFrame:
    """Word counts: what a multiset is when order does not matter; partial sums before the shuffle."""
    return texts.select(*keys, F.explode(tx.words(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(count))


def shares(a: Column, b: Column, both: Column) -> tuple[Column, Column]:
    """both/a and both/b; an empty side counts 1 if the other is empty too, else 0."""
    precision = F.when(a > 0, both / a).when(b > 0, 0.0).otherwise(1.0)
    recall = F.when(b > 0, both / b).when(a > 0, 0.0).otherwise(1.0)
    return precision, recall


def scored(df: DataFrame, keys: list[str], a: str, b: str, both: str) -> DataFrame:
    p, r = shares(F.col(a), F.col(b), F.col(both))
    out = df.withColumn("p", p).withColumn("r", r)
    return out.select(*keys, F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(tx.f_score(F.col("p"), F.col("r")), 6).alias("f1"))


def edits(original: DataFrame, predicted: DataFrame, reference: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key the sizes of removed, preserved and added multisets of prediction and reference, and what they share.

    With counts o, p, r of a word: removed is max(o - x, 0), preserved min(o, x), added max(x - o, 0).
    """
    all_ = counted(original, keys, text, "o").join(counted(predicted, keys, text, "p"), [*keys, "token"], "full").join(counted(reference, keys, text, "r"), [*keys, "token"], "full").na.fill(0, ["o", "p", "r"])
    removed, kept, added = (lambda x: F.greatest(F.col("o") - F.col(x), F.lit(0))), (lambda x: F.least("o", x)), (lambda x: F.greatest(F.col(x) - F.col("o"), F.lit(0)))
    # the k-th copies of a word are what is compared: removed copies are the last ones, kept the first, added those beyond o
    sums = []
    for name, of in (("removed", removed), ("preserved", kept), ("added", added)):
        sums += [F.sum(of("p")).alias(f"{name}_p"), F.sum(of("r")).alias(f"{name}_r"), F.sum(F.least(of("p"), of("r"))).alias(f"{name}_both")]
    return all_.groupBy(*keys).agg(*sums)


def label_pairs(alignment: DataFrame, keys: list[str]) -> DataFrame:
    """(o, a) for all numbers of a row; (o, NULL) where nothing is on the other side; rows without originals give none."""
    one = alignment.select(*keys, F.explode("original_nums").alias("o"), "abridged_nums")
    return one.select(*keys, "o", F.explode_outer("abridged_nums").alias("a")).distinct()


def alignment_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Per key n_pred, n_gold, precision, recall, f1 over label pairs; a pair with NULL equals its like."""
    p, g = label_pairs(predicted, keys), label_pairs(gold, keys)
    marked = p.withColumn("p", F.lit(1)).withColumn("g", F.lit(0)).unionByName(g.withColumn("p", F.lit(0)).withColumn("g", F.lit(1)))
    return marked_scores(marked, keys)


def marked_scores(marked: DataFrame, keys: list[str]) -> DataFrame:
    """alignment_scores of label pairs (o, a) that columns p and g mark as predicted and as gold; a pair may stand in several rows."""
    # grouping treats NULLs as equal: one shuffle does for the null-safe intersection
    pairs = marked.groupBy(*keys, "o", "a").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    sums = pairs.groupBy(*keys).agg(F.sum("p").cast("bigint").alias("n_pred"), F.sum("g").cast("bigint").alias("n_gold"), F.sum(F.col("p") * F.col("g")).alias("both"))
    p_, r_ = F.coalesce(F.try_divide("both", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("both", "n_gold"), F.lit(0.0))
    return sums.select(*keys, "n_pred", "n_gold", p_.alias("precision"), r_.alias("recall")).withColumn("f1", tx.f_score(F.col("precision"), F.col("recall")))


def cell_counts(pairs: DataFrame) -> DataFrame:
    """From (chapter_idx, rater, o, a): per cell how many raters chose it."""
    return pairs.where("a IS NOT NULL").groupBy("chapter_idx", "o", "a").agg(F.count_distinct("rater").alias("votes"), F.collect_set("rater").alias("raters"))


def grid_sizes(pairs: DataFrame) -> DataFrame:
    """Cells of each chapter's full grid, from 0 to the largest number on either side."""
    return pairs.groupBy("chapter_idx").agg(((F.max("o") + 1) * (F.coalesce(F.max("a"), F.lit(0)) + 1)).cast("bigint").alias("cells"))


def cohen(n: Column, a: Column, b: Column, both: Column) -> Column:
    """Cohen's kappa of two binary raters from n cells, their positives and shared positives; NULL if chance agrees always."""
    po = (n - a - b + 2 * both) / n
    pe = (a * b + (n - a) * (n - b)) / (n * n)
    return F.when(pe < 1, (po - pe) / (1 - pe))


def fleiss(n: Column, raters: int, votes: Column, squares: Column) -> Column:
    """Fleiss' kappa of binary ratings from n items: the sum of positive votes and, over items, of votes squared plus non-votes squared."""
    agree = (squares - n * raters) / (n * raters * (raters - 1))
    p = votes / (n * raters)
    chance = p * p + (1 - p) * (1 - p)
    return F.when(chance < 1, (agree - chance) / (1 - chance))
