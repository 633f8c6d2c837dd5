"""Cutting oversized labelled records into overlapping pieces at their strongest natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.llm.boundaries import SENTENCE, strengths

LIMIT, OVERLAP = 200, 20

#: Strength of a cut inside an entity and inside a word.
IN_ENTITY, IN_WORD = -1, -2


def usable(tokens: str = "tokens", labels: str = "bio_labels") -> Column:
    """Both arrays present, not empty and equally long."""
    return F.col(tokens).isNotNull() & F.col(labels).isNotNull() & (F.size(tokens) > 0) & (F.size(tokens) == F.size(labels))


class Strongest:
    """Range-maximum index over cut strengths; ties go to the right. Built in n log n, asked in constant time."""

    def __init__(self, strength: list[int]):
        n = len(strength)
        row = np.asarray(strength, dtype=np.int64) * n + np.arange(n)  # the place breaks ties
        self.n, self.rows = n, [row]
        step = 1
        while 2 * step <= n:
            row = np.maximum(row[: len(row) - step], row[step:])
            self.rows.append(row)
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        """The rightmost of the strongest places from ``lo`` to ``hi``, both included."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.rows[level]
        return int(max(row[lo], row[hi - (1 << level) + 1]) % self.n)


def cut_strengths(tokens: list, labels: list) -> list[int]:
    """Boundary strengths, lowered where a cut would part an entity or a word, unless a sentence opens there."""
    out = strengths(tokens)
    for k in range(1, len(out)):
        if out[k] < SENTENCE:
            if tokens[k] and tokens[k].startswith("##"):
                out[k] = IN_WORD
            elif labels[k] and labels[k][:2] in ("I-", "i-"):
                out[k] = IN_ENTITY
    return out


def spans(strength: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open spans of at most ``limit`` tokens; each begins ``overlap`` tokens before the end of the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n, start, out = len(strength), 0, []
    index = Strongest(strength)
    while n - start > limit:
        end = index.best(start + overlap + 1, start + limit)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def long_records(df: DataFrame, key: str, limit: int = LIMIT, tokens: str = "tokens", labels: str = "bio_labels") -> DataFrame:
    """(``key``, tokens, labels, ``strength``) of the usable records of more than ``limit`` tokens.

    Records that are null, empty or of unequal length in either array give no row, nor do short ones; only the
    three columns are read. Null tokens stay in their places and open nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [cut_strengths(t, x) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.list_(pa.int32()))], ["key", "tokens", "labels", "strength"])

    rows = df.where(usable(tokens, labels) & (F.size(tokens) > limit)).select(key, tokens, labels)
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, tokens array<string>, labels array<string>, strength array<int>").withColumnRenamed("key", key)


def boundaries(records: DataFrame, key: str) -> DataFrame:
    """(``key``, ``cut_at``): each place where a sentence or a numbered point opens, from long_records' strengths."""
    places = F.filter(F.sequence(F.lit(1), F.size("strength") - 1), lambda k: F.get("strength", k) == SENTENCE)
    return records.select(key, F.explode(places).alias("cut_at"))


def pieces(records: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(``key``, ``piece``, ``start``, ``end``, ``tokens``, ``bio_labels``) of long_records' rows; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [[{"piece": i, "start": x, "end": y} for i, (x, y) in enumerate(spans(s, limit, overlap))] for s in b.column(3).to_pylist()]
            kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(told, kind)], ["key", "tokens", "labels", "at"])

    kind = records.schema[key].dataType.simpleString()
    at = records.select(key, "tokens", "labels", "strength").mapInArrow(run, f"key {kind}, tokens array<string>, labels array<string>, at array<struct<piece:int,start:int,end:int>>")
    one = at.select("key", "tokens", "labels", F.explode("at").alias("p"))
    part = lambda c: F.slice(c, F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return one.select(F.col("key").alias(key), "p.piece", "p.start", "p.end", part("tokens").alias("tokens"), part("labels").alias("bio_labels"))
