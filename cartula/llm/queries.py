"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import html.entities
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.llm import budget, calibration, chunks, leakage, mixture, splits, tokenizer, truncation
from cartula.functions.names import name_key
from cartula.plans.lineage import checkpoint_folder, cut, table


def _sampled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = {n: table(spark, folder, n) for n in ("train_subset_10k", "sample_targets", "tag_taxonomy")}
    return calibration.sample(t["train_subset_10k"], t["sample_targets"], t["tag_taxonomy"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of each plan that have fewer usable rows than needed."""
    return _sampled(spark, folder)[1].where("short").select("plan_id", "category")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each plan wanted, what there is and what was drawn."""
    return _sampled(spark, folder)[1]


def p5_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Need, rows there are and, for plans in which a row has one category, rows drawn: exactly the need where there are so many."""
    one = F.when(F.col("field_name") != "bio_labels", F.col("drawn"))
    return _sampled(spark, folder)[1].select("plan_id", "category", "need", "available", one.alias("drawn"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled rows of each plan."""
    return _sampled(spark, folder)[0]


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training and an evaluation record that are the same or nearly so."""
    t, v = table(spark, folder, "deepmount_pii_it_train"), table(spark, folder, "validation_real")
    return leakage.overlaps(t, v, "rec_id", "rec_id").select(F.col("train_id").alias("train_rec_id"), F.col("eval_id").alias("val_rec_id"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping evaluation records per split and source."""
    t, v = table(spark, folder, "deepmount_pii_it_train"), table(spark, folder, "validation_real")
    return leakage.overlap_report(leakage.links(t, v, "rec_id", "rec_id"), v, "rec_id", "split", "source")


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    docs = budget.documents(table(spark, folder, "train_subset_10k"), "rec_id", "tokens", "source", "language", "subject_domain")
    return budget.first_run(spark, docs)[1]


def p2_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and documents per source, language and domain."""
    return _totals(spark, folder)


def p2_updated(spark: SparkSession, folder: str) -> DataFrame:
    """The totals after a second run of the kept state: first over an earlier snapshot of the table, in which a tenth of the rows were
    absent, a tenth had other tokens and another source, and a tenth more stood that are gone since; then over the table as it is."""
    rows = table(spark, folder, "train_subset_10k")
    part = F.pmod(F.xxhash64("rec_id"), F.lit(10))
    changed = part == 1
    now = {"tokens": F.when(changed, F.concat("tokens", F.array(F.lit("prima")))).otherwise(F.col("tokens")), "source": F.when(changed, F.lit("earlier")).otherwise(F.col("source"))}
    gone = rows.where(part == 2).withColumn("rec_id", -F.col("rec_id") - 1)
    earlier = rows.where(part != 0).withColumns(now).unionByName(gone)
    read = lambda df: budget.documents(df, "rec_id", "tokens", "source", "language", "subject_domain")
    path = f"{checkpoint_folder(spark)}/budget-{uuid.uuid4().hex}"
    budget.maintain(read(earlier), path)
    return budget.maintain(read(rows), path)


def p2_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per source, language and domain after the second run; the source under its key."""
    t = p2_updated(spark, folder).select(name_key(F.col("source")).alias("source"), "language", name_key(F.col("subject_domain")).alias("subject_domain"), "documents")
    return t


def p2_cube(spark: SparkSession, folder: str) -> DataFrame:
    """The same with all roll-ups."""
    return budget.cube(_totals(spark, folder))


def _long(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.long_records(table(spark, folder, "synthetic_pii_it_200k"), "rec_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Natural boundaries of the records that are too long."""
    return chunks.boundaries(_long(spark, folder), "rec_id")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of the records that are too long."""
    return chunks.pieces(_long(spark, folder), "rec_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of groups in which at least two known templates occur."""
    return splits.related(table(spark, folder, "synthetic_pii_it_200k"), table(spark, folder, "legal_templates"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its group and its split."""
    return splits.records_in_splits(spark, table(spark, folder, "synthetic_pii_it_200k"), table(spark, folder, "legal_templates"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each group and in how many splits they are."""
    told = p4_splits(spark, folder)
    return told.groupBy("group").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("split").alias("splits"))


def _sizes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixture.measured(table(spark, folder, "documents"), "doc_id", "text", "source")
    return sizes, mixture.budgets(sizes, table(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources too small for their weight even when every document is used as often as allowed."""
    return _sizes(spark, folder)[1].where("short").select("source")


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the mixture and how often it is used."""
    return mixture.mixture(*_sizes(spark, folder))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    sizes, plan = _sizes(spark, folder)
    return mixture.shares(mixture.mixture(sizes, plan), plan)


def _lengths(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    ends = cut(truncation.read_endings(table(spark, folder, "documents"), "doc_id", "text", "source"))
    return ends, cut(truncation.limits(ends))


def _endings(spark: SparkSession, folder: str) -> DataFrame:
    ends, found = _lengths(spark, folder)
    full = cut(truncation.filling(ends, found))
    forms = truncation.line_forms(ends.join(full, "id", "left_anti"))
    uses = cut(truncation.word_uses(table(spark, folder, "documents"), "text", ends))
    return truncation.truncated(ends, full, forms, uses)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off before its end."""
    return _endings(spark, folder).where("cut").select(F.col("id").alias("doc_id"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.report(_endings(spark, folder))


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The storage limits that the lengths of all texts show."""
    return _lengths(spark, folder)[1].withColumn("expected", F.round("expected", 6))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_token_budget": p2_token_budget,
    "p2_updated": p2_updated,
    "p2_documents": p2_documents,
    "p2_cube": p2_cube,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_drawn": p5_drawn,
    "p5_sample": p5_sample,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_limits": p8_limits,
}
_NAME = "CASE WHEN regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') NOT IN ('', 'nd', 'null', 'sconosciuta', 'na', 'none') THEN regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END"
_LANG = "CASE WHEN regexp_replace(lower(language), '[^a-z]+', '', 'g') NOT IN ('', 'nd') THEN coalesce(map {'deu': 'de', 'ger': 'de', 'eng': 'en', 'spa': 'es', 'fra': 'fr', 'fre': 'fr', 'ita': 'it', 'nld': 'nl', 'dut': 'nl'}[regexp_extract(lower(trim(language)), '^[a-z]+')], regexp_extract(lower(trim(language)), '^[a-z]+')) END"

_NEEDS = f"""
WITH u AS (SELECT * FROM train_subset_10k WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels)),
m AS (SELECT rec_id, 'source' AS field_name, {_NAME.format("source")} AS k FROM u UNION ALL SELECT rec_id, 'language', {_LANG} FROM u
 UNION ALL SELECT DISTINCT rec_id, 'bio_labels', coarse_tag FROM (SELECT rec_id, upper(unnest(bio_labels)) AS l FROM u) JOIN tag_taxonomy ON raw_tag = substr(l, 3) WHERE l[:2] IN ('B-', 'I-')),
c AS (SELECT field_name, k, count(*) AS n FROM m WHERE k IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CASE field_name WHEN 'source' THEN {_NAME.format("category")} ELSE category END AS k,
 greatest(round_even(sample_fraction * (SELECT count(*) FROM u) * target_share, 0), min_rows) AS need FROM sample_targets)
"""

_UNITS = "length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]'))"
_MARKED = "length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))"
_LINES = "len(regexp_extract_all(text, '\\n')) - len(regexp_extract_all(text, '\\r\\n'))"
_TWO, _SIX = "len(regexp_extract_all(text, '[\"\\\\\\x08\\x0c\\n\\r\\t]'))", "5 * len(regexp_extract_all(text, '[\\x00-\\x07\\x0b\\x0e-\\x1f]'))"
_WIDE = "5 * len(regexp_extract_all(text, '[^\\x00-\\x{ffff}]')) * 2 + 5 * len(regexp_extract_all(text, '[\\x80-\\x{ffff}]')) + len(regexp_extract_all(text, '[^\\x00-\\x{ffff}]'))"
_ENTITY = "list_sum(list_transform(regexp_extract_all(text, '[&<>\"\\x{a0}-\\x{2666}]'), lambda c: coalesce(map {%s}[ord(c)], 0)))" % ", ".join(f"{c}: {len(n) + 1}" for c, n in sorted(html.entities.codepoint2name.items()))
_MEASURED = {
    "chars": "length(text)", "utf8": "strlen(text)", "utf16": _UNITS, "markup": _MARKED,
    "markup_quotes": _MARKED + " + 5 * len(regexp_extract_all(text, '[\"'']'))", "markup_utf8": f"strlen(text) + {_MARKED} - length(text)", "markup_names": f"length(text) + coalesce({_ENTITY}, 0)",
    "json": f"length(text) + {_TWO} + {_SIX}", "json_utf8": f"strlen(text) + {_TWO} + {_SIX}", "json_ascii": f"length(text) + {_TWO} + {_SIX} + {_WIDE}",
    "crlf": f"length(text) + {_LINES}", "crlf_utf8": f"strlen(text) + {_LINES}", "lf": "length(text) - len(regexp_extract_all(text, '\\r\\n'))", "lf_utf8": "strlen(text) - len(regexp_extract_all(text, '\\r\\n'))",
}
_T = truncation
_OVER = f"{{0}} >= {_T.EXCESS} * {{1}} AND {{0}} >= {{1}} + {_T.PILE} + {_T.SIGMAS} * sqrt(greatest({{1}}, 0))"
_STEP, _MORE = round(100_000 * _T.NEAR), _T.LEAST_NEAR / _T.NEAR

SQL: dict[str, str] = {
    "p8_limits": f"""
WITH d AS (SELECT DISTINCT {_NAME.format('source')} AS src, text FROM documents WHERE regexp_matches(text, '[^\\s\\x0b\\x00\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200d}}\\x{{2028}}-\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]')),
l AS (SELECT src, unnest([{", ".join(f"struct_pack(measure := '{m}', size := CAST({x} AS BIGINT))" for m, x in _MEASURED.items())}]) AS x FROM d),
c AS (SELECT src, x.measure AS measure, x.size AS size, count(*) AS texts, CAST(round(ln(x.size + {_MORE}) * 100000) AS BIGINT) AS scaled FROM l GROUP BY ALL),
w AS (SELECT *, sum(texts) OVER n AS about, sum(texts) OVER b AS banded, max(texts) OVER b AS most, count(*) OVER b AS kinds, {2 * _T.NEAR} * (size + {_MORE}) AS span FROM c
 WINDOW n AS (PARTITION BY src, measure ORDER BY scaled RANGE BETWEEN {_STEP} PRECEDING AND {_STEP} FOLLOWING), b AS (PARTITION BY src, measure ORDER BY size RANGE BETWEEN {_T.WORD_BAND} PRECEDING AND CURRENT ROW)),
m AS (SELECT *, (about - texts) / span AS mean, (about - banded) * {_T.WORD_BAND + 1} / (span - {_T.WORD_BAND + 1}) AS band_mean FROM w),
f AS (SELECT src, measure, size, scaled, texts, mean AS expected, 0 AS band FROM m WHERE {_OVER.format('texts', 'mean')}
 UNION ALL SELECT src, measure, size, scaled, banded, band_mean, {_T.WORD_BAND} FROM m WHERE {_OVER.format(f'banded - {_T.PILE}', 'band_mean')} AND kinds >= 3 AND most < 0.5 * banded),
g AS (SELECT *, max(texts) OVER (PARTITION BY src ORDER BY scaled RANGE BETWEEN {_STEP} PRECEDING AND {_STEP} FOLLOWING) AS best FROM f),
h AS (SELECT *, max(texts) OVER (PARTITION BY src, measure, band ORDER BY scaled RANGE BETWEEN {_STEP} PRECEDING AND {_STEP} FOLLOWING) AS top,
 max(CASE WHEN band = 0 THEN texts END) OVER (PARTITION BY src ORDER BY scaled RANGE BETWEEN {_STEP} PRECEDING AND {_STEP} FOLLOWING) AS sharp FROM g WHERE texts >= {_T.AS_WELL} * best)
SELECT src, measure, CAST(size AS INTEGER) AS size, CAST(texts AS BIGINT) AS texts, round(expected, 6) AS expected, CAST(band AS INTEGER) AS band FROM h WHERE band = 0 OR texts = top AND sharp IS NULL""",
    "p4_groups": f"""
WITH RECURSIVE r AS (SELECT rec_id, CASE WHEN template_id IN (SELECT id FROM legal_templates) THEN template_id END AS t,
 nullif(CASE WHEN regexp_replace(regexp_replace(lower(source), '\\.jsonl[\\s/]*$', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g') NOT IN ('', 'nd', 'null', 'sconosciuta') THEN regexp_replace(regexp_replace(lower(source), '\\.jsonl[\\s/]*$', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END, '') AS s FROM synthetic_pii_it_200k),
e AS (SELECT DISTINCT a.t AS x, b.t AS y FROM (SELECT DISTINCT t, s FROM r) a JOIN (SELECT DISTINCT t, s FROM r) b ON a.s = b.s WHERE a.t IS NOT NULL AND b.t IS NOT NULL),
w AS (SELECT DISTINCT t AS x, t AS y FROM r WHERE t IS NOT NULL UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y),
g AS (SELECT x, min(y) AS m FROM w GROUP BY x), o AS (SELECT s, min(t) AS t FROM r WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY s)
SELECT CASE WHEN g.m IS NOT NULL THEN 't' || g.m WHEN r.s IS NOT NULL THEN 's' || r.s ELSE 'r' || r.rec_id END AS "group", CAST(count(*) AS BIGINT) AS records, CAST(1 AS BIGINT) AS splits
FROM r LEFT JOIN o ON r.s = o.s LEFT JOIN g ON g.x = coalesce(r.t, o.t) GROUP BY 1""",
    "p2_documents": f"SELECT {_NAME.format('source')} AS source, {_LANG} AS language, {_NAME.format('subject_domain')} AS subject_domain, CAST(count(*) AS BIGINT) AS documents FROM train_subset_10k GROUP BY 1, 2, 3",
    "p5_found": _NEEDS + "SELECT t.plan_id, t.category FROM t LEFT JOIN c ON c.field_name = t.field_name AND c.k = t.k WHERE coalesce(c.n, 0) < t.need",
    "p5_drawn": _NEEDS + """SELECT t.plan_id, t.category, CAST(t.need AS BIGINT) AS need, CAST(coalesce(c.n, 0) AS BIGINT) AS available,
 CASE WHEN t.field_name <> 'bio_labels' THEN CAST(least(t.need, coalesce(c.n, 0)) AS BIGINT) END AS drawn FROM t LEFT JOIN c ON c.field_name = t.field_name AND c.k = t.k""",
    "p4_found": f"""
WITH RECURSIVE r AS (SELECT rec_id, CASE WHEN template_id IN (SELECT id FROM legal_templates) THEN template_id END AS t,
 nullif(CASE WHEN regexp_replace(regexp_replace(lower(source), '\\.jsonl[\\s/]*$', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g') NOT IN ('', 'nd', 'null', 'sconosciuta') THEN regexp_replace(regexp_replace(lower(source), '\\.jsonl[\\s/]*$', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END, '') AS s FROM synthetic_pii_it_200k),
e AS (SELECT DISTINCT a.t AS x, b.t AS y FROM r a JOIN r b ON a.s = b.s WHERE a.t IS NOT NULL AND b.t IS NOT NULL),
w AS (SELECT DISTINCT t AS x, t AS y FROM r WHERE t IS NOT NULL UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y),
g AS (SELECT x, min(y) AS m, count(*) AS n FROM w GROUP BY x),
o AS (SELECT s, min(t) AS t FROM r WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY s)
SELECT r.rec_id, g.m AS group_template_id FROM r LEFT JOIN o ON r.s = o.s JOIN g ON g.x = coalesce(r.t, o.t) WHERE g.n >= 2""",
}
