"""Between character spans, BIO labels and token spans; splicing snippets into labelled token lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartula.functions.text import TOKEN, let, matches, span_list, uniform, without_suffix
from cartula.operators.taxonomy import OUTSIDE, lookup
from cartula.plans.lineage import cut

TokenSpans = "array<struct<type:string,s:int,e:int>>"


def encode(text: Column, entities: Column) -> tuple[Column, Column]:
    """(tokens, labels): a token wholly inside an entity gets its label, B- where both start together.

    Of entities that overlap, the first of the list counts. ``entities``: array of structs with start, end, label.
    """
    toks = matches(text, TOKEN)

    def tag(t: Column, ents: Column) -> Column:
        around = F.filter(ents, lambda x: (t["start"] >= x["start"]) & (t["end"] <= x["end"]))
        told = lambda e: F.when(e.isNull(), "O").otherwise(F.concat(F.when(t["start"] == e["start"], "B-").otherwise("I-"), e["label"]))
        return let(F.get(around, F.lit(0)), told)

    return F.transform(toks, lambda t: t["value"]), let(entities, lambda ents: F.transform(toks, lambda t: tag(t, ents)))


def encode_outside(text: Column, literal: Column, table: dict[str, str] = OUTSIDE) -> tuple[Column, Column]:
    """(tokens, labels) from a list literal of spans: numbered labels, tags by the table, later spans over earlier
    ones, B- at the first token that a span holds. Spans whose tag the table lacks are left out."""
    mapped = F.transform(span_list(literal), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), lookup(without_suffix(s["label"]), table).alias("tag")))
    toks = matches(text, TOKEN)

    def tag(t: Column, i: Column, toks: Column, spans: Column) -> Column:
        around = F.filter(spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]))
        first = lambda e: (i == 0) | (F.get(toks, i - 1)["start"] < e["start"])
        return let(F.try_element_at(around, F.lit(-1)), lambda e: F.when(e.isNull(), "O").otherwise(F.concat(F.when(first(e), "B-").otherwise("I-"), e["tag"])))

    known = F.filter(mapped, lambda s: s["tag"].isNotNull())
    labels = let(known, lambda spans: let(toks, lambda all_: F.transform(all_, lambda t, i: tag(t, i, all_, spans))))
    return F.transform(toks, lambda t: t["value"]), labels


def decode(labels: Column) -> Column:
    """Token spans (type, s, e) of a label array, in order: a span opens at B-, at I- after O or of another type."""
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("s"), F.lit(0).alias("i"), F.array().cast(TokenSpans).alias("out"))
    close = lambda a: F.when(a["t"].isNotNull(), F.concat(a["out"], F.array(F.struct(a["t"].alias("type"), a["s"].alias("s"), a["i"].alias("e"))))).otherwise(a["out"]).cast(TokenSpans)

    def step(a: Column, x: Column) -> Column:
        kind = F.when((x != "O") & x.isNotNull(), F.substring(x, 3, 1000))
        goes_on = kind.isNotNull() & ~F.startswith(x, F.lit("B-")) & kind.eqNullSafe(a["t"])
        return F.struct(kind.alias("t"), F.when(goes_on, a["s"]).otherwise(a["i"]).alias("s"), (a["i"] + 1).alias("i"), F.when(goes_on, a["out"]).otherwise(close(a)).cast(TokenSpans).alias("out"))

    return F.aggregate(labels, start, step, close)


def decode_rows(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(``key``, type, s, e) by gaps and islands over exploded labels; for label arrays too long for one row's fold."""
    one = df.select(F.col(key).alias("d__key"), F.posexplode(labels).alias("i", "label")).withColumn("type", F.when(F.col("label") != "O", F.substring("label", 3, 1000)))
    w = Window.partitionBy("d__key").orderBy("i")
    opens = F.col("type").isNotNull() & (F.startswith("label", F.lit("B-")) | ~F.col("type").eqNullSafe(F.lag("type").over(w)))
    island = one.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("int")).over(w)).where("type is not null")
    spans = island.groupBy("d__key", "island", "type").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e"))
    return spans.select(F.col("d__key").alias(key), "type", "s", "e")


def spots(tokens: Column, labels: Column) -> Column:
    """Places after a full stop or semicolon outside entities, where a snippet can go."""
    both = F.arrays_zip(tokens.alias("t"), labels.alias("l"))
    marked = F.transform(both, lambda x, i: F.when(x["t"].isin(".", ";") & (x["l"] == "O"), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def splice(tokens: Column, labels: Column, new_tokens: Column, new_labels: Column, pick: Column) -> tuple[Column, Column]:
    """(tokens, labels) with a snippet put in at one of the spots, at the end where there is none.

    ``pick``: a number in [0, 1) that chooses the spot.
    """
    at = let(spots(tokens, labels), lambda p: F.when(F.size(p) > 0, F.get(p, F.floor(pick * F.size(p)).cast("int"))).otherwise(F.size(tokens)))
    put = lambda old, new: F.concat(F.slice(old, F.lit(1), at), new, F.slice(old, at + 1, F.greatest(F.size(old) - at, F.lit(0))))
    return put(tokens, new_tokens), put(labels, new_labels)


def augment(df: DataFrame, key: str, tokens: str, labels: str, snippets: list[Column], seed: int = 42) -> DataFrame:
    """``df`` with one splice for each snippet column (a struct of tokens and labels, null for none), in turn.

    Spots are found anew after each splice, so a snippet can land inside one put in before.
    """
    for i, s in enumerate(snippets):
        df = df.withColumn("a__s", s)
        t, x = splice(F.col(tokens), F.col(labels), F.col("a__s.tokens"), F.col("a__s.labels"), uniform(F.col(key), F.lit(i), seed=seed))
        has = F.col("a__s").isNotNull()
        df = df.withColumns({"a__t": F.when(has, t).otherwise(F.col(tokens)), "a__x": F.when(has, x).otherwise(F.col(labels))})
        df = df.withColumns({tokens: F.col("a__t"), labels: F.col("a__x")}).drop("a__s", "a__t", "a__x")
    return df


def cycle(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows numbered ``turn`` from 0: the table's rows in order, again and again. An empty table gives none.

    Numbering is distributed by ranges of ``order`` counted beforehand; nothing is gathered.
    """
    numbered = with_position(rows, order)
    size = numbered.count()
    if not size:
        return numbered.limit(0).withColumnRenamed("position", "turn")
    turns = rows.sparkSession.range(n).select(F.col("id").alias("turn"), (F.col("id") % size).alias("position"))
    return turns.join(numbered, "position").drop("position")


def with_position(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``position``: 0-based place by ``order``, from counts of range partitions and ranks inside them."""
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("p__id", F.spark_partition_id())
    kept = cut(ranged)
    counts = kept.groupBy("p__id").agg(F.count(F.lit(1)).alias("p__n"))
    before = counts.select("p__id", F.coalesce(F.sum("p__n").over(Window.orderBy("p__id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p__before"))
    inside = F.row_number().over(Window.partitionBy("p__id").orderBy(order)) - 1
    return kept.withColumn("p__in", inside).join(F.broadcast(before), "p__id").withColumn("position", F.col("p__before") + F.col("p__in")).drop("p__id", "p__in", "p__before")  # one row a partition
