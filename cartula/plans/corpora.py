"""Jobs that put corpora together: a validation set with all tags, rows enriched by snippets, what an outside corpus loses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.functions.text import choose, span_list, uniform, without_suffix
from cartula.operators.bio import cycle, splice
from cartula.operators.generate import WORDS, Vocabulary, render_rows
from cartula.operators.subset import shuffled
from cartula.operators.taxonomy import OUTSIDE, lookup

#: Rows of each base corpus and of each tag that neither has, in a validation set.
BASE, PER_TAG = 2500, 400


def enriched(rows: DataFrame, key: str, snippets: dict[str, list[str]], n: int, tag: str | None = None, most: int = 2, seed: int = 42, words: Vocabulary = WORDS) -> DataFrame:
    """(``turn``, ``tag``, ``tokens``, ``bio_labels``): ``n`` rows, the table's again and again in order of ``key``, each with one
    snippet or up to ``most`` spliced in after a sentence.

    ``snippets``: templates with slots by the tag that they bring; with ``tag`` only those of this tag are drawn. Values,
    snippets and places depend on the turn and the seed alone. An empty table or no snippet gives no rows.
    """
    texts = [t for k, some in sorted(snippets.items()) for t in some if tag in (None, k)]
    base = cycle(rows.select(key, "tokens", "bio_labels"), key, n)
    if not texts:
        return base.limit(0).select("turn", F.lit(tag).alias("tag"), "tokens", "bio_labels")
    for i in range(most):
        drawn = base.select("turn", choose(texts, F.col("turn"), F.lit(f"{tag} {i}"), seed=seed).alias("template"))
        put = render_rows(drawn, "turn", "template", seed + i, words).select("turn", F.col("tokens").alias("new_t"), F.col("bio_labels").alias("new_x"))
        wanted = F.lit(True) if i == 0 else uniform(F.col("turn"), F.lit(f"more {i}"), seed=seed) < 0.5
        t, x = splice(F.col("tokens"), F.col("bio_labels"), F.col("new_t"), F.col("new_x"), uniform(F.col("turn"), F.lit(f"place {i}"), seed=seed))
        base = base.join(put, "turn").select(key, "turn", F.when(wanted, t).otherwise(F.col("tokens")).alias("t"), F.when(wanted, x).otherwise(F.col("bio_labels")).alias("bio_labels")).withColumnRenamed("t", "tokens")
    return base.select("turn", F.lit(tag).alias("tag"), "tokens", "bio_labels")


def validation_set(first: DataFrame, second: DataFrame, key: str, snippets: dict[str, list[str]], base: int = BASE, per_tag: int = PER_TAG, seed: int = 2024) -> DataFrame:
    """(``part``, ``tokens``, ``bio_labels``): ``base`` rows of each of two corpora in seeded order (fewer where there are fewer) and,
    for each tag of ``snippets``, ``per_tag`` rows of the first corpus not among these with one snippet of the tag; where the first
    corpus has no other rows, its chosen ones are used again."""
    a, b = shuffled(first, key, base, seed), shuffled(second, key, base, seed)
    rest = first.join(a.select(key), key, "left_anti")
    donors = rest if not rest.isEmpty() else a
    out = a.select(F.lit("first").alias("part"), "tokens", "bio_labels").unionByName(b.select(F.lit("second").alias("part"), "tokens", "bio_labels"))
    for tag in sorted(snippets):
        out = out.unionByName(enriched(donors, key, snippets, per_tag, tag, 1, seed).select(F.col("tag").alias("part"), "tokens", "bio_labels"))
    return out


def dropped_types(rows: DataFrame, literal: str, table: dict[str, str] = OUTSIDE) -> DataFrame:
    """(``type``, ``spans``): types of an outside corpus's span lists that the table lacks, and how many spans they had."""
    one = rows.select(F.explode(F.transform(span_list(F.col(literal)), lambda s: without_suffix(s["label"]))).alias("type"))
    return one.where(lookup(F.col("type"), table).isNull()).groupBy("type").agg(F.count(F.lit(1)).alias("spans"))


def share_of(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: rows, those that meet a condition (rows of new templates, say) and their share; 0 of an empty table."""
    hits = F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0))
    one = rows.agg(F.count(F.lit(1)).alias("rows"), hits.alias("hits"))
    return one.withColumn("share", F.when(F.col("rows") > 0, F.col("hits") / F.col("rows")).otherwise(0.0))
