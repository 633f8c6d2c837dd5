"""Seeded ranks and picks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_rank(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank", buckets: int = 1024) -> DataFrame:
    """``df`` with ``name``: the 1-based place of each row in its group, in a seeded order.

    ``order`` starts with a hash (BIGINT); further columns break its ties. Rows are ranked inside
    (group, hash bucket) and shifted by the counts of the lower buckets, so that a group that holds a third of
    all rows is still spread over ``buckets`` tasks. Rows with equal order share no rank; give a unique last
    column for a fixed result. An empty frame gives an empty frame; null group values form a group of their own.
    """
    b, off, n, inner = f"{name}__b", f"{name}__o", f"{name}__n", f"{name}__r"
    keyed = df.withColumn(b, F.floor((order[0] / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    counts = keyed.groupBy(*groups, b).agg(F.count(F.lit(1)).alias(n))
    below = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*groups, b, F.coalesce(F.sum(n).over(below), F.lit(0)).alias(off))
    within = Window.partitionBy(*groups, b).orderBy(*order)
    ranked = keyed.withColumn(inner, F.row_number().over(within))
    on = [ranked[c].eqNullSafe(shifts[c]) for c in [*groups, b]]
    keep = [ranked[c] for c in df.columns]
    return ranked.join(shifts, on).select(*keep, (ranked[inner] + shifts[off]).alias(name))


def pick_per_group(df: DataFrame, quotas: DataFrame, groups: list[str], quota: str, order: list[Column]) -> DataFrame:
    """The first ``quota`` rows of each group in seeded order; groups without a quota give no rows."""
    ranked = hashed_rank(df, groups, order, name="pick__rank")
    wanted = quotas.select(*[F.col(g).alias(f"q__{g}") for g in groups], F.col(quota).alias("q__n"))
    on = [F.col(g).eqNullSafe(F.col(f"q__{g}")) for g in groups]
    return ranked.join(wanted, on).where(F.col("pick__rank") <= F.col("q__n")).select(*df.columns)
