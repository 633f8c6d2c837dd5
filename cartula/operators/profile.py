"""Profiles of labelled corpora: counts, shares, percentiles, first and longest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.operators.taxonomy import begins, tags_of, type_of


def by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def entities_by_label(df: DataFrame, labels: str) -> DataFrame:
    """Entities per tag: B- labels over the corpus."""
    one = df.select(F.explode(F.transform(begins(F.col(labels)), type_of)).alias("tag"))
    return one.groupBy("tag").agg(F.count(F.lit(1)).alias("entities"))


def rows_with_tag(df: DataFrame, labels: str) -> DataFrame:
    """Rows that hold a tag at least once."""
    return df.select(F.explode(tags_of(F.col(labels))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))


def label_tokens(df: DataFrame, labels: str) -> DataFrame:
    """Tokens per label."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("tokens"))


def top(counts: DataFrame, name: str, count: str, k: int = 40) -> DataFrame:
    """The ``k`` most frequent; ties by name."""
    return counts.orderBy(F.desc(count), name).limit(k)


def longest(df: DataFrame, key: str, tokens: str, k: int = 200) -> DataFrame:
    """The ``k`` rows with the most tokens; ties by key."""
    return df.select(key, F.size(tokens).alias("n")).where("n >= 0").orderBy(F.desc("n"), key).limit(k)


def length_percentiles(df: DataFrame, length: Column, marks: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """One row: rows, the exact percentiles, interpolated and cut to whole numbers, and the greatest length."""
    one = df.select(length.alias("n")).where("n is not null")
    cuts = [F.percentile("n", p / 100).cast("int").alias(f"p{p}") for p in marks]
    return one.agg(F.count(F.lit(1)).alias("rows"), *cuts, F.max("n").alias("most"))


def over(df: DataFrame, length: Column, limits: tuple[int, ...] = (128, 256, 512)) -> DataFrame:
    """One row: percent of rows longer than each limit."""
    one = df.select(length.alias("n")).where("n is not null")
    return one.agg(*[(F.avg((F.col("n") > x).cast("int")) * 100).alias(f"over_{x}") for x in limits])


def share_against(subset: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    """Per value: rows and percent in the subset and in the pool, and whether the subset has none."""
    part = lambda df, n: df.groupBy(column).agg(F.count(F.lit(1)).alias(n))
    a, b = part(subset, "in_subset"), part(pool, "in_pool")
    sizes = subset.agg(F.count(F.lit(1)).alias("s")).crossJoin(F.broadcast(pool.agg(F.count(F.lit(1)).alias("p"))))  # one row each
    both = b.join(a, b[column].eqNullSafe(a[column]), "left").select(b[column], F.coalesce("in_subset", F.lit(0)).alias("in_subset"), "in_pool")
    pct = lambda n, d: F.when(F.col(d) > 0, F.col(n) * 100.0 / F.col(d)).otherwise(0.0)
    return both.crossJoin(F.broadcast(sizes)).select(column, "in_subset", "in_pool", pct("in_subset", "s").alias("subset_pct"), pct("in_pool", "p").alias("pool_pct"), (F.col("in_subset") == 0).alias("zero"))


def quotas(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """Rows of each combination in proportion to ``n``, rounded, ties to even."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*columns, "rows", F.bround(F.lit(n) * F.col("rows") / F.col("total")).cast("bigint").alias("quota"))  # total: one row


def pass_rate(df: DataFrame, label: str, ok: str) -> DataFrame:
    """Per label: values, values whose check passed, share."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(ok).cast("bigint")).alias("passed")).withColumn("rate", F.col("passed") / F.col("n"))


def first_match(df: DataFrame, order: str, condition: Column, *columns: str) -> DataFrame:
    """One row: the columns of the first row, by order, that meets the condition; nulls where none does."""
    return df.where(condition).agg(*[F.min_by(c, order).alias(c) for c in columns])
