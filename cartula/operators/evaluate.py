"""Entity-level and token-level quality of predicted labels against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.functions.text import f1, ratio
from cartula.operators.bio import decode


def outcomes(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(``type``, ``outcome``): one row for each span: tp, fp or fn. Both label arrays stand in one row, so spans are
    compared in place; only counts move."""
    both = df.select(decode(F.col(gold)).alias("g"), decode(F.col(predicted)).alias("p"))
    named = lambda spans, name: F.transform(spans, lambda s: F.struct(s["type"].alias("type"), F.lit(name).alias("outcome")))
    hits, more, less = F.array_intersect("g", "p"), F.array_except("p", "g"), F.array_except("g", "p")
    return both.select(F.inline(F.concat(named(hits, "tp"), named(more, "fp"), named(less, "fn"))))


def per_tag(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(type, tp, fp, fn, support, precision, recall, f1); ratios without a denominator are 0."""
    is_ = lambda name: F.sum((F.col("outcome") == name).cast("bigint"))
    counts = outcomes(df, gold, predicted).groupBy("type").agg(is_("tp").alias("tp"), is_("fp").alias("fp"), is_("fn").alias("fn"))
    rows = counts.withColumn("support", F.col("tp") + F.col("fn"))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def summary(tags: DataFrame) -> DataFrame:
    """One row from per_tag's: micro precision, recall, f1 and support over all tags, macro f1 over tags with support."""
    s = tags.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.select("precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), "macro_f1")


def token_accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: tokens, tokens with the right label, their share."""
    right = F.size(F.filter(F.zip_with(gold, predicted, lambda g, p: g == p), lambda x: x))
    s = df.agg(F.coalesce(F.sum(F.size(gold)), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum(right), F.lit(0)).cast("bigint").alias("correct"))
    return s.withColumn("accuracy", ratio(F.col("correct"), F.col("tokens")))
