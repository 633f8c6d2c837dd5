"""Tokens per source, language and domain, kept up to date by differences.

A table of counts by content and tokenizer holds what was encoded once; a run encodes only texts that it lacks. Totals
are changed by signed deltas: a new document adds, a removed one subtracts, a changed one does both.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.functions.names import language_key, name_key, spelling
from cartula.llm.tokenizer import BYTE_BPE_50K, TOKENIZERS, _read, count_tokens
from cartula.plans.lineage import cut, lookup

CUBE = ["source", "language", "subject_domain"]

COUNTS = "tokenizer string, content binary, n_tokens bigint"
STATE = "id bigint, content binary, source string, language string, subject_domain string"


def tokenizer_key(path: str | None = None) -> str:
    """Hash of the vocabulary file: counts of another tokenizer are other rows."""
    return hashlib.sha256(_read(path or os.path.join(TOKENIZERS, BYTE_BPE_50K))).hexdigest()[:16]


def text_of(tokens: Column) -> Column:
    """The text that a token list stands for: pieces joined, no space before closing marks or after opening ones
    and apostrophes, none inside numbers, dates and addresses. Null where the list is; null tokens are left out."""
    spaced = F.array_join(tokens, " ")
    joined = F.regexp_replace(spaced, r"(?<=\S) ##(?=\S)", "")
    for pattern, to in (
        (r" ([.,;:!?…)\]}»%])", "$1"),
        (r"([(\[{«]) ", "$1"),
        (r"(\p{L}) (['’]) ?(?=\p{L})", "$1$2"),
        (r" ([/@_\-]) (?=[\p{L}\p{N}])", "$1"),
        (r"(?<=\p{N})([.,:]) (?=\p{N})", "$1"),
    ):
        joined = F.regexp_replace(joined, pattern, to)
    return joined


def canonical(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with each name of ``column`` under its commonest spelling (ties: the first); missing names are null."""
    keyed = rows.withColumn("n__key", name_key(F.col(column))).withColumn("n__spelt", spelling(F.col(column)))
    counts = keyed.where("n__key is not null").groupBy("n__key", "n__spelt").agg(F.count(F.lit(1)).alias("n__n"))
    best = counts.groupBy("n__key").agg(F.min_by("n__spelt", F.struct(-F.col("n__n"), F.col("n__spelt"))).alias("n__best"))
    return lookup(keyed, best, "n__key").withColumn(column, F.col("n__best")).drop("n__key", "n__spelt", "n__best")


def documents(rows: DataFrame, key: str, tokens: str, source: str, language: str, domain: str) -> DataFrame:
    """(``id``, ``content``, ``text``, ``source``, ``language``, ``subject_domain``): names under one spelling."""
    named = canonical(canonical(rows.select(F.col(key).alias("id"), text_of(F.col(tokens)).alias("text"), F.col(source).alias("source"), F.col(language).alias("language"), F.col(domain).alias("subject_domain")), "source"), "subject_domain")
    content = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return named.select("id", content.alias("content"), "text", "source", language_key(F.col("language")).alias("language"), "subject_domain")


def update_counts(counts: DataFrame, docs: DataFrame, path: str | None = None, only_new: bool = False) -> DataFrame:
    """``counts`` with a row for every content of ``docs``, or the new rows alone; each content that it lacks is encoded once."""
    tok = tokenizer_key(path)
    have = counts.where(F.col("tokenizer") == tok).select("content")
    new = docs.groupBy("content").agg(F.any_value("text").alias("text")).join(have, "content", "left_anti")
    fresh = count_tokens(new, "text", "n_tokens", path).withColumn("tokenizer", F.lit(tok)).select(*counts.columns)
    return fresh if only_new else counts.unionByName(fresh)


def deltas(before: DataFrame, after: DataFrame, counts: DataFrame, path: str | None = None) -> DataFrame:
    """(source, language, subject_domain, ``documents``, ``tokens``): signed changes from one state to the next.

    A state is (``id``, ``content``, source, language, subject_domain). Rows that both states hold cancel out before
    anything is joined. A content without a count is an error, not 0 tokens.
    """
    columns = ["id", "content", *CUBE]
    signed = after.select(*columns, F.lit(1).alias("sign")).unionByName(before.select(*columns, F.lit(-1).alias("sign")))
    changed = signed.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    tok = counts.where(F.col("tokenizer") == tokenizer_key(path)).select("content", "n_tokens")
    known = F.coalesce("n_tokens", F.raise_error(F.lit("a content has no count")).cast("bigint"))
    return changed.join(tok, "content", "left").groupBy(*CUBE).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * known).alias("tokens"))


def apply(totals: DataFrame, changes: DataFrame) -> DataFrame:
    """Totals after changes; slices that no document is left in vanish."""
    both = totals.select(*CUBE, "documents", "tokens").unionByName(changes.select(*CUBE, "documents", "tokens"))
    return both.groupBy(*CUBE).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")


def cube(totals: DataFrame) -> DataFrame:
    """All roll-ups of the totals; ``level`` tells which dimensions are summed over (a bit each, the last the lowest)."""
    return totals.cube(*CUBE).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("level"))


def first_run(spark: SparkSession, docs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and totals from nothing: (counts, totals)."""
    docs = cut(docs)
    counts = cut(update_counts(spark.createDataFrame([], COUNTS), docs, path))
    changes = deltas(spark.createDataFrame([], STATE), docs, counts, path)
    return counts, apply(changes.limit(0), changes)


def runs(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(run, tokenizer) of the finished runs kept under ``path``, the last one last; none where there is no such folder."""
    try:
        rows = spark.read.parquet(f"{path}/log").select("run", "tokenizer").collect()  # one row a run
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        rows = []
    return sorted((int(r["run"]), r["tokenizer"]) for r in rows)


def maintain(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Totals after one more run over a snapshot of all documents, kept with counts and state as Parquet under ``path``.

    Contents that no finished run counted under this tokenizer are encoded and added to the counts; the snapshot's
    differences from the last state, removed and changed documents among them, change the totals. With another
    tokenizer the totals are built anew from its counts. A run counts once its line in the log is written; what one that
    broke off has left is written over by the next.
    """
    spark, tok = docs.sparkSession, tokenizer_key(tokenizer)
    docs, done = cut(docs), runs(spark, path)
    run = done[-1][0] + 1 if done else 1
    read = lambda what, r: spark.read.parquet(f"{path}/{what}/run={r}")
    counts = spark.createDataFrame([], COUNTS)
    for old, _ in done:
        counts = counts.unionByName(read("counts", old))
    fresh = update_counts(counts, docs, tokenizer, only_new=True)
    fresh.write.mode("overwrite").parquet(f"{path}/counts/run={run}")
    counts = counts.unionByName(read("counts", run))
    same = bool(done) and done[-1][1] == tok
    before = read("state", done[-1][0]) if same else spark.createDataFrame([], STATE)
    changes = cut(deltas(before, docs, counts, tokenizer))
    totals = apply(read("totals", done[-1][0]) if same else changes.limit(0), changes)
    totals.write.mode("overwrite").parquet(f"{path}/totals/run={run}")
    docs.select("id", "content", *CUBE).write.mode("overwrite").parquet(f"{path}/state/run={run}")
    spark.createDataFrame([(tok,)], "tokenizer string").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/run={run}")
    return read("totals", run)
