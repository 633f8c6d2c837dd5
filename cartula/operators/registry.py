"""A small table of runs by version, and the newest of several versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(runs: DataFrame, new: DataFrame, version: str = "version", order: str = "trained_at") -> DataFrame:
    """Runs with new ones in place of those of the same version, in order of time, then version."""
    return runs.join(new.select(version), version, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(order, version)


def version_key(name: Column) -> Column:
    """The numbers of a version, in order, so that 1.10 comes after 1.9; null where there is none."""
    digits = F.regexp_extract_all(F.regexp_extract(name, r"(\d+(?:\.\d+)*)", 1), F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(digits) > 0, F.transform(digits, lambda d: d.cast("bigint")))


def newest(df: DataFrame, name: str) -> DataFrame:
    """One row: the name with the highest version; names without a version lose."""
    return df.where(version_key(F.col(name)).isNotNull()).agg(F.max_by(name, F.struct(version_key(F.col(name)).alias("k"), F.col(name).alias("n"))).alias(name))


def numbered_labels(df: DataFrame, *labels: str) -> DataFrame:
    """(``label``, ``id``): the different labels of several array columns, sorted, numbered from 0. Labels are as many as the taxonomy has."""
    one = None
    for c in labels:
        part = df.select(F.explode(c).alias("label")).distinct()
        one = part if one is None else one.union(part)
    return one.distinct().withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)
