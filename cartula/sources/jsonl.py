"""Records in JSON lines and Parquet: stated schemas, validity filter, languages, sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.operators.bio import encode_outside
from cartula.operators.generate import fillable
from cartula.operators.taxonomy import normalised, valid

OUTSIDE = "language string, source_text string, masked_text string, mbert_tokens array<string>, mbert_token_classes array<string>"
TRAINING = "tokens array<string>, bio_labels array<string>"
SYNTHETIC = "source_text string, language string, template_id int, entities array<struct<value:string,label:string,start:int,end:int>>, tokens array<string>, bio_labels array<string>"
TEMPLATE = "id int, doc_type string, text string"


def _lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def outside(spark: SparkSession, path: str, language: str | None = None, limit: int | None = None) -> DataFrame:
    """(tokens, bio_labels, language) of valid outside records, labels normalised; a limit keeps the first in file order."""
    rows = _lines(spark, path, OUTSIDE).withColumn("pos", F.monotonically_increasing_id())
    if language:
        rows = rows.where(F.col("language") == language)
    good = rows.where(valid(F.col("mbert_tokens"), F.col("mbert_token_classes")))
    if limit is not None:
        good = good.orderBy("pos").limit(limit)
    return good.select(F.col("mbert_tokens").alias("tokens"), normalised(F.col("mbert_token_classes")).alias("bio_labels"), "language")


def training(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, bio_labels) of valid records, labels normalised."""
    return _lines(spark, path, TRAINING).where(valid(F.col("tokens"), F.col("bio_labels"))).select("tokens", normalised(F.col("bio_labels")).alias("bio_labels"))


def strict(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, bio_labels) of records whose arrays are equally long; a record without either field is an error."""
    rows = _lines(spark, path, TRAINING, strict=True)
    both = F.when(F.col("tokens").isNull() | F.col("bio_labels").isNull(), F.raise_error(F.lit("a record lacks tokens or bio_labels"))).otherwise(F.size("tokens") == F.size("bio_labels"))
    return rows.where(both.cast("boolean"))


def pool(spark: SparkSession, files: list[dict]) -> DataFrame:
    """(tokens, bio_labels, language, source) of several files: dicts of path, schema (outside or training) and source.

    A missing file is passed over. An absent or empty language is ``?`` outside and ``it`` elsewhere.
    """
    out = None
    for f in files:
        try:
            if f["schema"] == "outside":
                rows, t, x, default = _lines(spark, f["path"], OUTSIDE), "mbert_tokens", "mbert_token_classes", "?"
            else:
                rows, t, x, default = _lines(spark, f["path"], TRAINING + ", language string"), "tokens", "bio_labels", "it"
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit(default))
        part = rows.where(valid(F.col(t), F.col(x))).select(F.col(t).alias("tokens"), normalised(F.col(x)).alias("bio_labels"), language.alias("language"), F.lit(f["source"]).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], TRAINING + ", language string, source string")


def spans(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, bio_labels) of Parquet rows with a text and a list literal of spans."""
    t, x = encode_outside(F.col("unmasked_text"), F.col("span_labels"))
    return spark.read.parquet(path).select("unmasked_text", "span_labels").select(t.alias("tokens"), x.alias("bio_labels"))


def templates(spark: SparkSession, path: str, known: list[str] | None = None) -> DataFrame:
    """Templates of a JSON array with at least one slot and no unknown one; a missing file gives none."""
    try:
        rows = spark.read.schema(TEMPLATE).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TEMPLATE)
    return rows.where(fillable(F.col("text"), known))


def write(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition."""
    df.write.mode("overwrite").json(path)


def write_report(summary: DataFrame, tags: DataFrame, path: str) -> None:
    """Metrics of an evaluation under ``path``: ``metrics`` as one JSON object with the figures per tag, ``text`` for reading, a line a tag."""
    per = tags.select(F.struct("type", "support", "precision", "recall", "f1").alias("r")).agg(F.array_sort(F.collect_list("r")).alias("per_tag"))  # as many as tags
    summary.crossJoin(F.broadcast(per)).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    line = F.format_string("%-20s %8d %.4f %.4f %.4f", "type", "support", "precision", "recall", "f1")
    tags.orderBy(F.desc("support"), "type").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/text")
