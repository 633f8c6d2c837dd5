"""The whole analysis of a text as one narrow projection: candidates, spans, placeholders, text, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.operators.detect import DETECTORS, Candidates, Detector, candidates
from cartula.operators.spans import dictionary, masked, merge, number, pseudonymised, segments
from cartula.operators.windows import count_windows, windows
from cartula.functions.text import let, words

#: A model: texts of windows in, for each a list of (label, start, end, score) out.
Model = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]


def counts(values: Column) -> Column:
    """Map of values to how often they occur, the most frequent first, then by first occurrence."""
    one = lambda v, vs: F.struct((-F.size(F.filter(vs, lambda x: x == v))).alias("n"), F.array_position(vs, v).alias("at"), v.alias("v"))
    pairs = let(values, lambda vs: F.transform(F.array_distinct(vs), lambda v: one(v, vs)))
    return F.map_from_entries(F.transform(F.array_sort(pairs), lambda p: F.struct(p["v"].alias("key"), (-p["n"]).alias("value"))))


def analyse(df: DataFrame, text: str, more: str | None = None, detectors: list[Detector] = DETECTORS) -> DataFrame:
    """``df`` with segments, anonymized_text, masked_text, mapping, n_chunks, n_chars, n_entities, n_unique, by_label, by_source.

    ``more``: a column of further candidates (from with_model). No shuffle, no Python. Null texts give nulls; an
    empty text gives empty results. Works alike on batches and streams.
    """
    t = F.col(text)
    own = candidates(t, detectors)
    all_ = F.concat(F.coalesce(F.col(more), F.array().cast(Candidates)), own) if more else own
    step = df.withColumn("a__kept", merge(all_, t)).withColumn("a__n", number(F.col("a__kept"), t)).withColumn("segments", segments(F.col("a__n"), t))
    n = F.col("a__n")
    return (
        step.withColumns(
            {
                "anonymized_text": pseudonymised(F.col("segments")),
                "masked_text": masked(F.col("segments")),
                "mapping": dictionary(n),
                "n_chunks": F.when(t.isNotNull(), count_windows(F.size(words(t)))),
                "n_chars": F.length(t),
                "n_entities": F.when(t.isNotNull(), F.size(n)),
                "by_label": counts(F.transform(n, lambda x: x["label"])),
                "by_source": counts(F.transform(n, lambda x: x["source"])),
            }
        )
        .withColumn("n_unique", F.when(t.isNotNull(), F.size("mapping")))
        .drop("a__kept", "a__n")
    )


def with_model(df: DataFrame, key: str, text: str, model: Callable[[], Model], name: str = "model") -> DataFrame:
    """``df`` with ``candidates``: what a token-classification model finds in the windows of each text.

    ``model`` is called once in each Python worker and gives the function that does the work; windows go to it in
    Arrow batches, offsets come back for the whole text. ``key`` must be unique. Texts without words get null.
    """
    one = df.select(F.col(key).alias("id"), F.explode(windows(F.col(text))).alias("w")).select("id", "w.chunk_no", "w.text", "w.offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model()
        for b in batches:
            rows = []
            for id_, no, off, got in zip(b["id"], b["chunk_no"], b["offset"], find(list(b["text"])), strict=True):
                rows += [(id_, no, i, label, start + off, end + off, score) for i, (label, start, end, score) in enumerate(got)]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "i", "label", "start", "end", "score"])

    kind = df.schema[key].dataType.simpleString()
    found = one.mapInPandas(run, f"id {kind}, chunk_no int, i int, label string, start int, end int, score double")
    each = F.struct("chunk_no", "i", "label", "start", "end", "score")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(each)).alias("all"))
    cands = F.transform(
        "all",
        lambda c, i: F.struct(c["label"].alias("label"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score"), F.lit(False).alias("validated"), F.lit(name).alias("source"), i.alias("ord")),
    ).cast(Candidates)
    return df.join(lists.select(F.col("id").alias(key), cands.alias("candidates")), key, "left")


def to_json(mapping: Column) -> Column:
    """A dictionary as JSON."""
    return F.to_json(mapping)


def from_json(text: Column) -> Column:
    """A dictionary from JSON; null when it is none."""
    return F.from_json(text, "map<string,string>")
