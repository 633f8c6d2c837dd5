"""From candidates to disjoint spans, placeholders, pseudonymised text and back; one narrow projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartula.functions.text import lead, let, placeholder, same_value, tail
from cartula.operators.detect import Candidates

Kept = "array<struct<label:string,start:int,end:int,score:double,validated:boolean,source:string,ord:int,value:string,ph:string>>"
Segments = "array<struct<t:string,label:string,ph:string,src:string,validated:boolean>>"


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def merge(candidates: Column, text: Column) -> Column:
    """The candidates that stay: taken by priority when disjoint from all taken before, trimmed, in reading order.

    Priority: a passed check, then patterns before the model, score, length; among equals the earlier candidate.
    Overlap is judged before white space at the edges is trimmed; what is empty then goes.
    """
    ranked = F.array_sort(
        F.transform(
            candidates,
            lambda c: F.struct(
                F.when(c["validated"], 0).otherwise(1).alias("a"), F.when(c["source"] == "regex", 0).otherwise(1).alias("b"), (-c["score"]).alias("c"),
                (c["start"] - c["end"]).alias("d"), c["ord"].alias("e"), c.alias("x"),
            ),
        )
    )
    free = lambda kept, c: F.forall(kept, lambda k: (c["end"] <= k["start"]) | (c["start"] >= k["end"]))
    kept = F.aggregate(ranked, F.array().cast(Candidates), lambda a, r: F.when(free(a, r["x"]), F.concat(a, F.array(r["x"]))).otherwise(a))

    def trimmed(c: Column) -> Column:
        value = _cut(text, c["start"], c["end"])
        start = c["start"] + lead(value)
        end = F.greatest(start, F.least(c["end"], F.length(text)) - tail(value))  # nothing of a span lies beyond the text
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), c["label"].alias("label"), c["score"].alias("score"), c["validated"].alias("validated"), c["source"].alias("source"), c["ord"].alias("ord"))

    out = F.array_sort(F.filter(F.transform(kept, trimmed), lambda c: c["end"] > c["start"]))
    return F.transform(out, lambda c: F.struct(*[c[n].alias(n) for n in ("label", "start", "end", "score", "validated", "source", "ord")])).cast(Candidates)


def number(kept: Column, text: Column) -> Column:
    """Spans with ``value`` and ``ph``: each label counts its different values in reading order."""
    valued = F.transform(kept, lambda k: F.struct(k.alias("k"), _cut(text, k["start"], k["end"]).alias("v")))
    keyed = F.transform(valued, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), F.concat(x["k"]["label"], F.lit("\x01"), same_value(x["v"])).alias("key")))

    def named(x: Column, keys: Column) -> Column:
        upto = F.slice(keys, F.lit(1), F.array_position(keys, x["key"]).cast("int"))
        n = F.size(F.array_distinct(F.filter(upto, lambda y: F.startswith(y, F.concat(x["k"]["label"], F.lit("\x01"))))))
        fields = [x["k"][c].alias(c) for c in ("label", "start", "end", "score", "validated", "source", "ord")]
        return F.struct(*fields, x["v"].alias("value"), placeholder(x["k"]["label"], n).alias("ph"))

    return let(keyed, lambda all_: let(F.transform(all_, lambda x: x["key"]), lambda keys: F.transform(all_, lambda x: named(x, keys)))).cast(Kept)


def dictionary(numbered: Column) -> Column:
    """Map of placeholders to the values first met."""
    firsts = F.aggregate(numbered, F.array().cast(Kept), lambda a, x: F.when(F.exists(a, lambda y: y["ph"] == x["ph"]), a).otherwise(F.concat(a, F.array(x))))
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["ph"].alias("key"), x["value"].alias("value"))))


def segments(numbered: Column, text: Column) -> Column:
    """The text as literal and marked parts in turn; empty literal parts are left out."""
    lit = lambda a, b: F.struct(_cut(text, a, b).alias("t"), *[F.lit(None).cast("string").alias(n) for n in ("label", "ph", "src")], F.lit(None).cast("boolean").alias("validated"))
    start = F.struct(F.lit(0).alias("p"), F.array().cast(Segments).alias("out"))

    def step(a: Column, x: Column) -> Column:
        before = F.when(x["start"] > a["p"], F.array(lit(a["p"], x["start"]))).otherwise(F.array().cast(Segments))
        mark = F.struct(x["value"].alias("t"), x["label"].alias("label"), x["ph"].alias("ph"), x["source"].alias("src"), x["validated"].alias("validated"))
        return F.struct(x["end"].alias("p"), F.concat(a["out"], before, F.array(mark)).cast(Segments).alias("out"))

    rest = lambda a: F.when(a["p"] < F.length(text), F.concat(a["out"], F.array(lit(a["p"], F.length(text))))).otherwise(a["out"])
    return F.aggregate(numbered, start, step, lambda a: rest(a).cast(Segments))


def pseudonymised(parts: Column) -> Column:
    """The text with placeholders for marked parts."""
    return F.array_join(F.transform(parts, lambda s: F.coalesce(s["ph"], s["t"])), "")


def masked(parts: Column) -> Column:
    """The text with ``[LABEL]`` for marked parts; can't be undone."""
    return F.array_join(F.transform(parts, lambda s: F.coalesce(F.concat(F.lit("["), s["label"], F.lit("]")), s["t"])), "")


def restore(text: Column, values: Column) -> Column:
    """Placeholders back to values, longest first, one after the other.

    Brackets may be missing, spaces and asterisks around are taken in; so a bare ``X_1`` in ``X_10`` is replaced,
    too, and spaces next to a bare one go. ``restore_exact`` has none of this.
    """
    entries = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))

    def step(out: Column, e: Column) -> Column:
        inner = F.substring(e["key"], F.lit(2), F.length(e["key"]) - 2)
        pattern = F.concat(F.lit(r"(?U)\**\[?[\s﻿]*\Q"), inner, F.lit(r"\E[\s﻿]*\]?\**"))
        value = F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(out, pattern, value)

    return F.when(values.isNull(), text).otherwise(F.aggregate(entries, text, step))


def restore_exact(text: Column, values: Column) -> Column:
    """Whole placeholders in brackets back to values in one pass; unknown ones stay, values are not read again."""
    mark = r"\[[^\[\]]*_\d+\]"
    pairs = F.arrays_zip(F.split(text, mark, -1).alias("gap"), F.regexp_extract_all(text, F.lit(mark), F.lit(0)).alias("mark"))  # one more gap
    both = F.transform(pairs, lambda x: F.concat(x["gap"], F.coalesce(F.element_at(values, x["mark"]), x["mark"], F.lit(""))))
    return F.when(values.isNull(), text).otherwise(F.array_join(both, ""))


def number_rows(spans: DataFrame, key: str) -> DataFrame:
    """Exploded spans (``key``, label, start, value) with ``n`` and ``ph``; for documents with very many entities."""
    keyed = spans.withColumn("s__key", same_value(F.col("value")))
    first = keyed.withColumn("s__first", F.min("start").over(Window.partitionBy(key, "label", "s__key")))
    n = F.dense_rank().over(Window.partitionBy(key, "label").orderBy("s__first"))
    return first.withColumn("n", n).withColumn("ph", placeholder(F.col("label"), F.col("n"))).drop("s__key", "s__first")

