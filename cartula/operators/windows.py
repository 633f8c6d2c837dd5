"""Overlapping windows of words over a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartula.functions.text import BLOCK, let, matches

MOST_WORDS, OVERLAP = 120, 20


def count_windows(n: Column, most: int = MOST_WORDS, overlap: int = OVERLAP) -> Column:
    """Windows that ``n`` words take: none for no words, else enough for the last to reach the end."""
    step = max(1, most - overlap)
    return F.when(n == 0, 0).when(n <= most, 1).otherwise(1 + F.ceil((n - most) / step)).cast("int")


def windows(text: Column, most: int = MOST_WORDS, overlap: int = OVERLAP) -> Column:
    """Array of (chunk_no, text, offset): windows of at most ``most`` words that share ``overlap``; no word is cut."""
    kind = "array<struct<chunk_no:int,text:string,offset:int>>"
    step = max(1, most - overlap)

    def one(i: Column, blocks: Column) -> Column:
        first = F.get(blocks, (i * step).cast("int"))
        last = F.get(blocks, F.least(i * step + most, F.size(blocks)).cast("int") - 1)
        return F.struct(i.cast("int").alias("chunk_no"), F.substring(text, first["start"] + 1, last["end"] - first["start"]).alias("text"), first["start"].alias("offset"))

    def of(blocks: Column) -> Column:
        n = F.size(blocks)
        some = F.transform(F.sequence(F.lit(0), count_windows(n, most, overlap) - 1), lambda i: one(i, blocks)).cast(kind)
        return F.when(n == 0, F.array().cast(kind)).otherwise(some)

    return F.when(text.isNull(), F.lit(None).cast(kind)).otherwise(let(matches(text, BLOCK), of))
