"""Cutting lineage and choosing join sides, the same way on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's ``spark.checkpoint.dir`` is used when the cluster names one. A temporary folder of our own is made only on
    a master of one machine, and goes when the process ends; on a cluster a missing folder is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            named = tempfile.mkdtemp(prefix="cartula-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; a lost executor costs no recomputation of what led to it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that may be broadcast.
BROADCAST_ROWS = 50_000


def broadcast_within(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only after counting that it has at most ``most_rows`` rows.

    Beyond the bound the frame is returned without a hint, so that the join shuffles. What leads to ``df`` runs for
    the count and again for the join: cut a frame first whose plan is long.
    """
    few = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if few else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint that a join with ``df`` shuffles and merges (a broadcast hint on the other side still wins).

    Spark guesses the size of a frame made by a generator or by Python from the bytes of the files behind it, and would send
    one to the driver that is a hundred times as large as guessed.
    """
    return df.hint("merge")


#: A key is hot when more than so small a part of all rows has it; there are fewer hot keys than its inverse.
HOT = 0.001


def lookup(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with a table of unique keys, however large the table and however many rows share a key.

    A table within the bound is broadcast. Beyond it the rows of hot keys (fewer than 1 / HOT keys, by a count of all
    rows) meet a broadcast of these keys alone, rows without a key none, and only the rest is shuffled. Keys that the
    table lacks give nulls.
    """
    small = cut(small)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, "left")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("h__n"))
    total = rows.agg(F.count(F.lit(1)).alias("h__all"))
    hot = cut(counts.crossJoin(F.broadcast(total)).where(F.col("h__n") > HOT * F.col("h__all")).select(key))  # total: one row
    of_hot = F.broadcast(hot.join(small, key, "left").withColumn("h__hot", F.lit(True)))  # under 1 / HOT rows
    marked = rows.join(of_hot, key, "left")
    more = [c for c in small.columns if c != key]
    first = marked.where(F.col("h__hot") | F.col(key).isNull()).select(*rows.columns, *more)
    rest = marked.where(F.col("h__hot").isNull() & F.col(key).isNotNull()).select(*rows.columns).join(small, key, "left")
    return first.unionByName(rest.select(*rows.columns, *more))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores, for work that is heavy on each row.

    A few small files are one task each however many cores wait; only then the rows are dealt out anew. A table with
    enough partitions, as any large one, is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
