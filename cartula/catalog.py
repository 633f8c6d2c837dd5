"""Every query of the core by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.functions import checksums as ck
from cartula.functions import text as tx
from cartula.functions.names import language_key, name_key
from cartula.operators import bio, detect, evaluate, generate, profile, ranking, registry, spans, subset, taxonomy, windows
from cartula.operators.components import components
from cartula.functions.sql import register
from cartula.plans import corpora
from cartula.plans.analysis import analyse
from cartula.plans.lineage import broadcast_within, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SYN, TRAIN, VAL, SUB, DOCS = "synthetic_pii_it_200k", "deepmount_pii_it_train", "validation_real", "train_subset_10k", "documents"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, DOCS).select("doc_id", "text", "lang", "source").where("text is not null"))


# ---- detectors and pseudonymisation


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS value FROM documents)
SELECT doc_id, value, CAST(count(*) AS BIGINT) AS hits FROM d GROUP BY ALL""")
def email_hits(s, d):
    """Addresses of each document."""
    one = detect.detect(_docs(s, d), "doc_id", "text", [x for x in detect.DETECTORS if x.label == "EMAIL"])
    return one.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("hits"))


_WORDED = r"""unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])({0})(?:$|[^\p{{L}}\p{{N}}_])', 1))"""
_ODDS = "[1,0,5,7,9,13,15,17,19,21,1,0,5,7,9,13,15,17,19,21,2,4,18,20,11,3,6,8,12,14,16,10,22,25,24,23]"
_PLACE = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(upper({0}), i, 1))"
_CF_SUM = f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN {_ODDS}[{_PLACE.format('value')}] WHEN {_PLACE.format('value')} <= 10 THEN {_PLACE.format('value')} - 1 ELSE {_PLACE.format('value')} - 11 END))"


@query(
    f"""
WITH d AS (SELECT doc_id, {_WORDED.format('[A-Za-z]{6}[0-9]{2}[A-Za-z][0-9]{2}[A-Za-z][0-9]{3}[A-Za-z]')} AS value FROM documents)
SELECT doc_id, value, chr(CAST(65 + {_CF_SUM} % 26 AS INTEGER)) = upper(substr(value, 16, 1)) AS validated, CAST(count(*) AS BIGINT) AS hits FROM d GROUP BY ALL"""
)
def cf_hits(s, d):
    """Tax codes of each document with the outcome of their check."""
    one = detect.detect(_docs(s, d), "doc_id", "text", [x for x in detect.DETECTORS if x.label == "CF"])
    return one.groupBy("doc_id", "value", "validated").agg(F.count(F.lit(1)).alias("hits"))


_MOD97 = "list_reduce(list_transform(string_split({0}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97, 0)"


@query(
    f"""
WITH d AS (SELECT doc_id, {_WORDED.format('[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}')} AS value FROM documents)
SELECT doc_id, value, CAST(count(*) AS BIGINT) AS hits FROM d WHERE length(value) BETWEEN 15 AND 34
AND {_MOD97.format("substr(upper(value), 5) || substr(upper(value), 1, 4)")} = 1 GROUP BY ALL"""
)
def iban_hits(s, d):
    """Account numbers of each document that pass their check."""
    one = detect.detect(_docs(s, d), "doc_id", "text", [x for x in detect.DETECTORS if x.label == "IBAN"])
    return one.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("hits"))


_VAT = "list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({0}, i, 1) AS INTEGER) ELSE (CAST(substr({0}, i, 1) AS INTEGER) * 2) // 10 + (CAST(substr({0}, i, 1) AS INTEGER) * 2) % 10 END))"


# A decimal digit of any script: scripts have theirs in one run, so it is worth as many as there are digits just before it.
_ASCII = "array_to_string(list_transform(string_split(value, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(len(list_filter(range(1, 10), lambda k: len(list_filter(range(1, k + 1), lambda j: NOT regexp_matches(chr(CAST(ord(c) - j AS INTEGER)), '\\p{Nd}'))) = 0)) AS VARCHAR) END), '')"


@query(
    f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{Nd}}+')) AS value FROM documents), e AS (SELECT doc_id, value, {_ASCII} AS ten FROM d WHERE length(value) = 11)
SELECT doc_id, value, CAST(count(*) AS BIGINT) AS hits FROM e WHERE (10 - {_VAT.format('ten')} % 10) % 10 = CAST(substr(ten, 11, 1) AS INTEGER) GROUP BY ALL"""
)
def piva_hits(s, d):
    """VAT numbers of each document that pass their check, in digits of any script."""
    return _hits(s, d, "PIVA")


_UW = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _hits(s: SparkSession, d: str, label: str) -> DataFrame:
    one = detect.detect(_docs(s, d), "doc_id", "text", [x for x in detect.DETECTORS if x.label == label])
    return one.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("hits"))


def _hits_sql(pattern: str, group: int, where: str = "TRUE") -> str:
    return f"WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', {group})) AS value FROM documents) SELECT doc_id, value, CAST(count(*) AS BIGINT) AS hits FROM d WHERE {where} GROUP BY ALL"


@query(_hits_sql(rf"(?i)(?:(?:€|EUR|euro){_UW}?\p{{Nd}}{{1,3}}(?:(?:[.]|{_UW})\p{{Nd}}{{3}})*(?:,\p{{Nd}}{{2}})?|\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{3}})*,\p{{Nd}}{{2}}{_UW}?(?:€|EUR|euro))", 0))
def amount_hits(s, d):
    """Amounts of each document."""
    return _hits(s, d, "AMOUNT")


@query(_hits_sql(rf"{_L}([A-Za-z]{{2}}{_UW}?\p{{Nd}}{{3}}{_UW}?[A-Za-z]{{2}}){_R}", 1))
def plate_hits(s, d):
    """Number plates of each document."""
    return _hits(s, d, "TARGA")


@query(
    _hits_sql(
        rf"(?:^|[^\p{{L}}\p{{N}}_.])((?:\+39(?:[.]|{_UW})?)?(?:3\p{{Nd}}{{2}}(?:[.]|{_UW})?\p{{Nd}}{{3}}(?:[.]|{_UW})?\p{{Nd}}{{3,4}}|0\p{{Nd}}{{1,3}}(?:[.]|{_UW})?\p{{Nd}}{{5,8}})){_R}", 1
    )
)
def phone_hits(s, d):
    """Telephone numbers of each document."""
    return _hits(s, d, "TELEPHONENUM")


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


@query(
    _hits_sql(
        r"(?:^|[^\p{Nd}])((?:\p{Nd}[ \-]?){13,19})(?:$|[^\p{Nd}])",
        1,
        f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) ELSE (CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * 2) // 10 + (CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0",
    )
)
def card_hits(s, d):
    """Card numbers of each document that pass their check."""
    return _hits(s, d, "CREDITCARDNUMBER")


@query()
def detected_by_label(s, d):
    """Spans that stay after the merge, by label, source of the span and language of the document."""
    kept = _docs(s, d).select("lang", F.explode(spans.merge(detect.candidates(F.col("text")), F.col("text"))).alias("k"))
    return kept.groupBy(language_key(F.col("lang")).alias("language"), F.col("k.label").alias("label"), F.col("k.source").alias("source")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.col("k.validated").cast("bigint")).alias("validated")
    )


@query()
def anonymized_documents(s, d):
    """The whole analysis of every document."""
    rows = analyse(_docs(s, d), "text")
    return rows.select("doc_id", "anonymized_text", F.to_json("mapping").alias("mapping"), "n_chunks", "n_chars", "n_entities", "n_unique")


_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def _mailed(s: SparkSession, d: str) -> DataFrame:
    return analyse(_docs(s, d), "text", detectors=[x for x in detect.DETECTORS if x.label == "EMAIL"])


# Gaps and matches in turn, each value under its first form in the document.
_GAPS = f"""
WITH t AS (SELECT doc_id, regexp_split_to_array(text, '{_MAIL}') AS g, regexp_extract_all(text, '{_MAIL}') AS m FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, unnest(m) AS value, generate_subscripts(m, 1) AS i FROM t),
f AS (SELECT doc_id, lower(value) AS k, min(i) AS first, arg_min(value, i) AS form FROM v GROUP BY 1, 2),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f),
e AS (SELECT v.doc_id, list(n.form ORDER BY v.i) AS forms, list('[EMAIL_' || n.n || ']' ORDER BY v.i) AS marks FROM v JOIN n ON n.doc_id = v.doc_id AND n.k = lower(v.value) GROUP BY 1)
"""


def _joined(parts: str) -> str:
    return f"SELECT t.doc_id, CASE WHEN e.doc_id IS NULL THEN g[1] ELSE array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({parts}, '')), '') END AS text FROM t LEFT JOIN e USING (doc_id)"


@query(_GAPS + _joined("forms[i]"))
def restore_roundtrip(s, d):
    """Each document with its addresses replaced and put back: as it was, but for repeated addresses in their first form."""
    rows = _mailed(s, d)
    return rows.select("doc_id", spans.restore_exact(F.col("anonymized_text"), F.col("mapping")).alias("text"))


@query(_GAPS + _joined("marks[i]"))
def pseudonymised_addresses(s, d):
    """Each document with placeholders for its addresses."""
    return _mailed(s, d).select("doc_id", F.col("anonymized_text").alias("text"))


@query(_GAPS + _joined("CASE WHEN i <= len(marks) THEN '[EMAIL]' END"))
def masked_addresses(s, d):
    """Each document with its addresses masked for good."""
    return _mailed(s, d).select("doc_id", F.col("masked_text").alias("text"))


@query(_GAPS + """, p AS (SELECT doc_id, unnest(m) AS value, generate_subscripts(m, 1) AS i, g, m FROM t)
SELECT doc_id, value, CAST(list_sum(list_transform(range(1, i + 1), lambda j: length(g[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0) AS INTEGER) AS start FROM p""")
def address_offsets(s, d):
    """Where each address stands, in code points."""
    one = detect.detect(_docs(s, d), "doc_id", "text", [x for x in detect.DETECTORS if x.label == "EMAIL"])
    return one.select("doc_id", "value", "start")


@query(_GAPS + """SELECT t.doc_id, CAST(length(array_to_string(g, '')) + coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) AS INTEGER) AS n_chars, CAST(len(m) AS INTEGER) AS n_entities,
 CAST(coalesce(q.n, 0) AS INTEGER) AS n_unique, CAST(CASE WHEN len(m) > 0 THEN len(m) END AS INTEGER) AS by_label, CAST(CASE WHEN len(m) > 0 THEN len(m) END AS INTEGER) AS by_source
 FROM t LEFT JOIN (SELECT doc_id, count(*) AS n FROM n GROUP BY 1) q USING (doc_id)""")
def analysis_counts(s, d):
    """Characters, addresses, different ones, and the counts by label and by source of the whole analysis."""
    return _mailed(s, d).select("doc_id", "n_chars", "n_entities", "n_unique", F.col("by_label")["EMAIL"].alias("by_label"), F.col("by_source")["regex"].alias("by_source"))


@query(
    r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS value,
  generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), 1) AS i FROM documents),
f AS (SELECT doc_id, lower(value) AS k, min(i) AS first, arg_min(value, i) AS value FROM m GROUP BY 1, 2)
SELECT doc_id, '[EMAIL_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first) || ']' AS ph, value FROM f"""
)
def email_dictionary(s, d):
    """Placeholders and first values of the addresses of each document."""
    one = detect.detect(_docs(s, d), "doc_id", "text", [x for x in detect.DETECTORS if x.label == "EMAIL"])
    numbered = spans.number_rows(one, "doc_id")
    return numbered.groupBy("doc_id", "ph").agg(F.min_by("value", "start").alias("value"))


_W = _UW[1:-1]


@query(
    rf"""WITH r AS (SELECT rec_id, source_text AS text, unnest(entities) AS e, generate_subscripts(entities, 1) - 1 AS i FROM {SYN} WHERE source_text IS NOT NULL AND entities IS NOT NULL),
c AS (SELECT rec_id, text, e.ent_label AS label, greatest(0, e.ent_start + k * (i % 4) - k) AS a, e.ent_end + 2 * k AS b, i % 3 = 0 AND k = 0 AS ok, CASE WHEN (i + k) % 2 = 0 THEN 'regex' ELSE 'model' END AS src, 0.5 + (i % 2) * 0.25 AS score, k * 1000 + i AS ord
 FROM r CROSS JOIN (VALUES (0), (1)) v(k)),
l AS (SELECT rec_id, any_value(text) AS text, list([struct_pack(p := CASE WHEN ok THEN 0 ELSE 1 END, q := CASE WHEN src = 'regex' THEN 0 ELSE 1 END, s := -score, d := a - b, o := ord, label := label, a := a, b := b)] ORDER BY ok DESC, src = 'regex' DESC, score DESC, b - a DESC, ord) AS c FROM c GROUP BY rec_id),
k AS (SELECT rec_id, text, unnest(list_reduce(c, lambda x, y: CASE WHEN len(list_filter(x, lambda z: z.b > y[1].a AND z.a < y[1].b)) = 0 THEN list_concat(x, y) ELSE x END)) AS z FROM l),
t AS (SELECT rec_id, z, substr(text, z.a + 1, z.b - z.a) AS v FROM k)
SELECT rec_id, z.label AS label, CAST(z.a + length(v) - length(regexp_replace(v, '^[{_W}]+', '')) AS INTEGER) AS start, CAST(z.o AS INTEGER) AS ord, regexp_replace(regexp_replace(v, '^[{_W}]+', ''), '[{_W}]+$', '') AS value
FROM t WHERE regexp_replace(v, '[{_W}]+', '', 'g') <> ''"""
)
def merged_spans(s, d):
    """The spans that stay when each gold entity competes with a moved copy of itself and its neighbours."""
    rows = table(s, d, SYN).where("source_text is not null and entities is not null")

    def moved(k: int):
        return F.transform(
            "entities",
            lambda e, i: F.struct(
                e["ent_label"].alias("label"), F.greatest(F.lit(0), e["ent_start"] + k * (i % 4) - k).alias("start"), (e["ent_end"] + 2 * k).alias("end"), (0.5 + (i % 2) * 0.25).cast("double").alias("score"),
                ((i % 3 == 0) & F.lit(k == 0)).alias("validated"), F.when((i + k) % 2 == 0, "regex").otherwise("model").alias("source"), (i + 1000 * k).alias("ord"),
            ),
        )

    one = rows.select("rec_id", "source_text", F.explode(spans.merge(F.concat(moved(0), moved(1)).cast(detect.Candidates), F.col("source_text"))).alias("k"))
    value = F.substring("source_text", F.col("k.start") + 1, F.col("k.end") - F.col("k.start"))
    return one.select("rec_id", "k.label", "k.start", "k.ord", value.alias("value"))


@query()
def masked_documents(s, d):
    """Documents with each entity as its label."""
    return analyse(_docs(s, d), "text").select("doc_id", "masked_text")


@query(
    r"""
WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS ten FROM customer)
SELECT c_custkey, ten || CAST((10 - """
    + _VAT.format("ten")
    + r""" % 10) % 10 AS VARCHAR) AS vat, TRUE AS ok FROM c"""
)
def vat_build(s, d):
    """VAT numbers built from customer keys, and whether they pass their check."""
    vat = ck.piva_build(F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    return table(s, d, "customer").select("c_custkey", vat.alias("vat")).withColumn("ok", ck.piva_exact(F.col("vat")))


_CIN = f"list_sum(list_transform(range(1, 23), lambda i: CASE WHEN i % 2 = 1 THEN {_ODDS}[CAST(substr(b, i, 1) AS INTEGER) + 1] ELSE CAST(substr(b, i, 1) AS INTEGER) END))"


@query(
    f"""
WITH s AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '01000' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 12, '0') AS b FROM supplier),
n AS (SELECT s_suppkey, chr(CAST(65 + {_CIN} % 26 AS INTEGER)) || b AS bban FROM s)
SELECT s_suppkey, 'IT' || lpad(CAST(98 - {_MOD97.format("bban || 'IT00'")} AS VARCHAR), 2, '0') || bban AS iban, TRUE AS ok FROM n"""
)
def iban_build(s, d):
    """Account numbers built from supplier keys, and whether they pass their check."""
    key = F.col("s_suppkey")
    iban = ck.iban_build(F.lpad(key.cast("string"), 5, "0"), F.lit("01000"), F.lpad((key * 7).cast("string"), 12, "0"))
    return table(s, d, "supplier").select("s_suppkey", iban.alias("iban")).withColumn("ok", ck.iban_ok(F.col("iban")))


@query(
    """
WITH p AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 13 AS VARCHAR), 15, '0') AS card FROM orders)
SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(card, i, 1) AS INTEGER)
  ELSE (CAST(substr(card, i, 1) AS INTEGER) * 2) // 10 + (CAST(substr(card, i, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0 AS ok FROM p"""
)
def luhn_raw(s, d):
    """The Luhn check of 16 digits made from order keys."""
    card = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 13).cast("string"), 15, "0"))
    return table(s, d, "orders").select("o_orderkey", ck.luhn_ok(card).alias("ok"))


@query(
    f"""
WITH e AS (SELECT unnest(entities) AS e FROM {SYN}), v AS (SELECT e.ent_label AS label, e.ent_value AS value FROM e WHERE e.ent_label IN ('CF', 'PIVA', 'IBAN')),
k AS (SELECT label, CASE
 WHEN label = 'CF' THEN regexp_full_match(value, '[0-9A-Z]{{15}}[A-Z]') AND chr(CAST(65 + {_CF_SUM} % 26 AS INTEGER)) = substr(value, 16, 1)
 WHEN label = 'PIVA' THEN regexp_full_match(value, '[0-9]{{11}}') AND (10 - {_VAT.format("CASE WHEN regexp_full_match(value, '[0-9]{11}') THEN value ELSE '00000000000' END")} % 10) % 10 = TRY_CAST(substr(value, 11, 1) AS INTEGER)
 ELSE regexp_full_match(value, '[0-9A-Z]+') AND {_MOD97.format("substr(value, 5) || substr(value, 1, 4)")} = 1 END AS ok FROM v)
SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS passed, sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*) AS rate FROM k GROUP BY label"""
)
def validated_rate(s, d):
    """Share of the gold tax codes, VAT and account numbers that pass their check."""
    e = table(s, d, SYN).select(F.explode("entities").alias("e")).select(F.col("e.ent_label").alias("label"), F.col("e.ent_value").alias("value")).where(F.col("label").isin("CF", "PIVA", "IBAN"))
    v = F.col("value")
    ok = F.when(F.col("label") == "CF", ck.cf_exact(v)).when(F.col("label") == "PIVA", ck.piva_exact(v)).otherwise(ck.iban_exact(v))
    return profile.pass_rate(e.withColumn("ok", ok), "label", "ok")


# ---- tokens, windows, BIO


_WORDS = r"len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"


@query(f"SELECT doc_id, CAST(n AS INTEGER) AS n_words, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 120 THEN 1 ELSE 1 + ceil((n - 120) / 100.0) END AS INTEGER) AS n_chunks FROM (SELECT doc_id, {_WORDS} AS n FROM documents WHERE text IS NOT NULL)")
def chunk_counts(s, d):
    """Words of each document and the windows that they take."""
    rows = _docs(s, d).select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"))
    return rows.withColumn("n_chunks", windows.count_windows(F.col("n_words")))


@query(
    rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_UW[1:-1]}]+') AS w, regexp_split_to_array(text, '[^{_UW[1:-1]}]+') AS g FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, w, g, len(w) AS n, unnest(range(0, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 120 THEN 1 ELSE 1 + ceil((len(w) - 120) / 100.0) END AS BIGINT))) AS k FROM t),
o AS (SELECT *, 100 * k + 1 AS a, least(100 * k + 120, n) AS b, list_sum(list_transform(range(1, 100 * k + 2), lambda j: length(g[j]))) + coalesce(list_sum(list_transform(range(1, 100 * k + 1), lambda j: length(w[j]))), 0) AS pos FROM c)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(pos AS INTEGER) AS "offset",
 substr(text, CAST(pos AS BIGINT) + 1, CAST(list_sum(list_transform(range(a, b + 1), lambda j: length(w[j]))) + coalesce(list_sum(list_transform(range(a + 1, b + 1), lambda j: length(g[j]))), 0) AS BIGINT)) AS text FROM o"""
)
def chunk_windows(s, d):
    """The windows of each document."""
    return _docs(s, d).select("doc_id", F.inline(windows.windows(F.col("text"))))


@query(
    r"""SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(source_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS token FROM """
    + SYN
    + ") GROUP BY token"
)
def token_counts(s, d):
    """How often each token occurs in the synthetic texts."""
    return table(s, d, SYN).select(F.explode(tx.tokens(F.col("source_text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _UW[1:-1] + "]"


def _encoded(label: str, order: str, begins: str, entities: str = "entities") -> str:
    """Tokens with offsets, the entity that holds each, and its label."""
    return rf"""WITH r AS (SELECT rec_id, source_text, {entities} AS entities FROM {SYN} WHERE source_text IS NOT NULL AND entities IS NOT NULL),
m AS (SELECT *, regexp_extract_all(source_text, '{_TOKEN}') AS w, regexp_split_to_array(source_text, '{_TOKEN}') AS g FROM r),
t AS (SELECT rec_id, unnest(w) AS w, unnest(g[:len(w)]) AS g, generate_subscripts(w, 1) AS i FROM m),
p AS (SELECT rec_id, w, i, CAST(sum(length(g) + length(w)) OVER (PARTITION BY rec_id ORDER BY i) AS INTEGER) AS e FROM t), q AS (SELECT *, e - length(w) AS s, lag(e - length(w), 1, -1) OVER (PARTITION BY rec_id ORDER BY i) AS before FROM p),
x AS (SELECT rec_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS o FROM r), y AS (SELECT rec_id, o, {label} AS label, e.ent_start AS a, e.ent_end AS b FROM x),
h AS (SELECT q.rec_id, q.i, arg_min(struct_pack(label := y.label, a := y.a), {order}) AS h FROM q JOIN y ON y.rec_id = q.rec_id AND q.s >= y.a AND q.e <= y.b WHERE y.label IS NOT NULL GROUP BY 1, 2),
l AS (SELECT q.rec_id, q.i, q.w, CASE WHEN h.h IS NULL THEN 'O' WHEN {begins} THEN 'B-' || h.h.label ELSE 'I-' || h.h.label END AS l FROM q LEFT JOIN h USING (rec_id, i))
SELECT r.rec_id, coalesce(string_agg(l.w, ' ' ORDER BY l.i), '') AS tokens, coalesce(string_agg(l.l, ' ' ORDER BY l.i), '') AS labels FROM r LEFT JOIN l USING (rec_id) GROUP BY r.rec_id"""


@query(_encoded("e.ent_label", "y.o", "q.s = h.h.a"))
def bio_encode(s, d):
    """Tokens and labels anew from the synthetic texts and their entities."""
    rows = table(s, d, SYN).where("source_text is not null and entities is not null")
    ents = F.transform("entities", lambda e: F.struct(e["ent_label"].alias("label"), e["ent_start"].alias("start"), e["ent_end"].alias("end")))
    t, x = bio.encode(F.col("source_text"), ents)
    return rows.select("rec_id", F.concat_ws(" ", t).alias("tokens"), F.concat_ws(" ", x).alias("labels"))


_TYPE = """CASE WHEN l = 'O' OR l IS NULL THEN NULL WHEN substr(l, 3) IN ('TITLE', 'TRIBUNAL') THEN NULL ELSE coalesce(map {%s}[substr(l, 3)], substr(l, 3)) END""" % ", ".join(f"'{k}': '{v}'" for k, v in taxonomy.COARSE.items())


@query(
    f"""
WITH t AS (SELECT rec_id, unnest(bio_labels) AS l, generate_subscripts(bio_labels, 1) AS i FROM {SUB} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels)),
c AS (SELECT rec_id, i, {_TYPE} AS t FROM t), p AS (SELECT *, lag(t) OVER (PARTITION BY rec_id ORDER BY i) AS b FROM c)
SELECT rec_id, string_agg(CASE WHEN t IS NULL THEN 'O' WHEN t = b THEN 'I-' || t ELSE 'B-' || t END, ' ' ORDER BY i) AS labels FROM p GROUP BY rec_id"""
)
def bio_normalize(s, d):
    """Labels of the usable subset rows under coarse tags."""
    rows = table(s, d, SUB).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels")))
    return rows.select("rec_id", F.concat_ws(" ", taxonomy.normalised(F.col("bio_labels"))).alias("labels"))


def _spans_sql(name: str, key: str = "rec_id") -> str:
    return f"""
SELECT {key}, type, CAST(min(i) AS INTEGER) AS s, CAST(max(i) + 1 AS INTEGER) AS e FROM (
  SELECT *, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM (
    SELECT *, type IS NOT NULL AND (l[:2] = 'B-' OR type IS DISTINCT FROM lag(type) OVER (PARTITION BY {key} ORDER BY i)) AS o FROM (
      SELECT {key}, l, i - 1 AS i, CASE WHEN l <> 'O' THEN substr(l, 3) END AS type FROM {name})))
WHERE type IS NOT NULL GROUP BY {key}, g, type"""


_LABELS = "(SELECT rec_id, unnest(bio_labels) AS l, generate_subscripts(bio_labels, 1) AS i FROM {0} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels))"


@query(_spans_sql(_LABELS.format(TRAIN)))
def bio_decode(s, d):
    """Token spans of the usable training records."""
    rows = table(s, d, TRAIN).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels")))
    return rows.select("rec_id", F.inline(bio.decode(F.col("bio_labels"))))


@query(_spans_sql(_LABELS.format(VAL)))
def bio_decode_windows(s, d):
    """The same of the evaluation records by window functions over exploded labels."""
    rows = table(s, d, VAL).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels")))
    return bio.decode_rows(rows, "rec_id", "bio_labels")


@query(
    f"""SELECT rec_id, CAST(i AS INTEGER) AS spot FROM (SELECT rec_id, unnest(tokens) AS t, unnest(bio_labels) AS l, generate_subscripts(tokens, 1) AS i FROM {TRAIN}
WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels)) WHERE t IN ('.', ';') AND l = 'O'"""
)
def sentence_spots(s, d):
    """Places where a snippet can be spliced in."""
    rows = table(s, d, TRAIN).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels")))
    return rows.select("rec_id", F.explode(bio.spots(F.col("tokens"), F.col("bio_labels"))).alias("spot"))


# ---- evaluation: gold labels against a rule that knows codes only


_CODES = ["CF", "IBAN", "PIVA", "EMAIL", "DATE"]


def _judged(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, VAL).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels"))).select("rec_id", "bio_labels")
    said = lambda x: F.when(F.substring(x, 3, 100).isin(_CODES), x).when(F.substring(x, 3, 100) == "CITY", F.lit("B-PROVINCE")).otherwise("O")
    return rows.withColumn("predicted", F.transform("bio_labels", said))


_PRED = f"CASE WHEN substr(l, 3) IN ({', '.join(repr(c) for c in _CODES)}) THEN l WHEN substr(l, 3) = 'CITY' THEN 'B-PROVINCE' ELSE 'O' END"
_JUDGED = (
    f"WITH gl AS {_LABELS.format(VAL)}, pl AS (SELECT rec_id, i, {_PRED} AS l FROM gl), g AS ({_spans_sql('gl')}), p AS ({_spans_sql('pl')}), "
    "b AS (SELECT coalesce(g.type, p.type) AS type, g.type IS NOT NULL AS ing, p.type IS NOT NULL AS inp FROM g FULL JOIN p USING (rec_id, type, s, e)), "
    "c AS (SELECT type, CAST(sum(CASE WHEN ing AND inp THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT ing THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT inp THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM b GROUP BY type), "
    "r AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM c), "
    "f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r) "
)


@query(_JUDGED + "SELECT * FROM f")
def eval_per_tag(s, d):
    """Counts and ratios per tag."""
    return evaluate.per_tag(_judged(s, d), "bio_labels", "predicted")


@query(
    _JUDGED
    + """, t AS (SELECT CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn, avg(CASE WHEN support > 0 THEN f1 END) AS macro FROM f), q AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fn AS s, macro FROM t)
SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, CAST(s AS BIGINT) AS support, round(macro, 9) AS macro_f1 FROM q"""
)
def eval_summary(s, d):
    """Micro and macro figures."""
    one = evaluate.summary(evaluate.per_tag(_judged(s, d), "bio_labels", "predicted"))
    return one.select(*[F.round(c, 9).alias(c) if c != "support" else F.col(c) for c in one.columns])


@query(f"SELECT CAST(count(*) AS BIGINT) AS tokens, CAST(sum(CASE WHEN l = {_PRED} THEN 1 ELSE 0 END) AS BIGINT) AS correct, sum(CASE WHEN l = {_PRED} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS accuracy FROM {_LABELS.format(VAL)}")
def eval_token_accuracy(s, d):
    """Share of tokens with the right label."""
    return evaluate.token_accuracy(_judged(s, d), "bio_labels", "predicted")


# ---- profiles


_NAME = "CASE WHEN regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') NOT IN ('', 'nd', 'null', 'sconosciuta', 'na', 'none') THEN regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END"
_LANG = (
    "CASE WHEN regexp_replace(lower({0}), '[^a-z]+', '', 'g') IN ('', 'nd') THEN NULL ELSE coalesce(map {{"
    + ", ".join(f"'{w}': '{k}'" for k, v in {"de": ["deu", "ger"], "en": ["eng"], "es": ["spa"], "fr": ["fra", "fre"], "it": ["ita"], "nl": ["nld", "dut"]}.items() for w in v)
    + "}}[regexp_extract(lower(trim({0})), '^[a-z]+')], regexp_extract(lower(trim({0})), '^[a-z]+')) END"
)


@query(f"SELECT {_NAME.format('source')} AS source, {_LANG.format('language')} AS language, CAST(count(*) AS BIGINT) AS rows FROM {SUB} GROUP BY 1, 2")
def rows_by_source_lang(s, d):
    """Rows per source and language, each under one spelling."""
    rows = table(s, d, SUB).select(name_key(F.col("source")).alias("source"), language_key(F.col("language")).alias("language"))
    return profile.by(rows, "source", "language")


@query(f"SELECT substr(l, 3) AS tag, CAST(count(*) AS BIGINT) AS entities FROM (SELECT unnest(bio_labels) AS l FROM {SYN}) WHERE l LIKE 'B-%' GROUP BY 1")
def entities_by_label(s, d):
    """Entities per tag."""
    return profile.entities_by_label(table(s, d, SYN), "bio_labels")


@query(f"SELECT tag, CAST(count(*) AS BIGINT) AS rows FROM (SELECT DISTINCT rec_id, substr(l, 3) AS tag FROM (SELECT rec_id, unnest(bio_labels) AS l FROM {SYN}) WHERE l <> 'O') GROUP BY 1")
def rows_with_tag(s, d):
    """Rows that hold each tag."""
    return profile.rows_with_tag(table(s, d, SYN), "bio_labels")


@query(f"SELECT l AS label, CAST(count(*) AS BIGINT) AS tokens FROM (SELECT unnest(bio_labels) AS l FROM {SYN}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def top_tags(s, d):
    """The 40 most frequent labels."""
    return profile.top(profile.label_tokens(table(s, d, SYN), "bio_labels"), "label", "tokens")


@query(f"SELECT rec_id, CAST(len(tokens) AS INTEGER) AS n FROM {SYN} WHERE tokens IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 200")
def longest_rows(s, d):
    """The 200 rows with the most tokens."""
    return profile.longest(table(s, d, SYN), "rec_id", "tokens")


@query(f"SELECT CAST(count(n) AS BIGINT) AS rows, {', '.join(f'CAST(trunc(quantile_cont(n, {p / 100})) AS INTEGER) AS p{p}' for p in (50, 90, 95, 99))}, CAST(max(n) AS INTEGER) AS most FROM (SELECT len(tokens) AS n FROM {SYN})")
def length_percentiles(s, d):
    """Percentiles of the rows' lengths in tokens."""
    return profile.length_percentiles(table(s, d, SYN), F.when(F.col("tokens").isNotNull(), F.size("tokens")))


@query("SELECT " + ", ".join(f"avg(CASE WHEN len(tokens) > {x} THEN 1 ELSE 0 END) * 100 AS over_{x}" for x in (128, 256, 512)) + f" FROM {SYN} WHERE tokens IS NOT NULL")
def over_threshold(s, d):
    """Percent of rows longer than each limit."""
    return profile.over(table(s, d, SYN), F.when(F.col("tokens").isNotNull(), F.size("tokens")))


@query(
    f"""WITH a AS (SELECT {_NAME.format('source')} AS source FROM {SUB} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels)), b AS (SELECT {_NAME.format('source')} AS source FROM {SUB}),
x AS (SELECT source, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1), y AS (SELECT source, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1)
SELECT y.source, coalesce(x.n, 0) AS in_subset, y.n AS in_pool, round(coalesce(x.n, 0) * 100.0 / (SELECT count(*) FROM a), 9) AS subset_pct, round(y.n * 100.0 / (SELECT count(*) FROM b), 9) AS pool_pct, coalesce(x.n, 0) = 0 AS zero
FROM y LEFT JOIN x ON x.source IS NOT DISTINCT FROM y.source"""
)
def share_vs_pool(s, d):
    """Shares of the sources among usable rows and among all."""
    pool = table(s, d, SUB).withColumn("source", name_key(F.col("source")))
    out = profile.share_against(pool.where(taxonomy.valid(F.col("tokens"), F.col("bio_labels"))), pool, "source")
    return out.withColumns({c: F.round(c, 9) for c in ("subset_pct", "pool_pct")})


@query(f"WITH k AS (SELECT {_NAME.format('source')} AS source, {_LANG.format('lang')} AS language FROM documents) SELECT source, language, CAST(count(*) AS BIGINT) AS rows, CAST(round_even(100.0 * count(*) / (SELECT count(*) FROM k), 0) AS BIGINT) AS quota FROM k GROUP BY 1, 2")
def quota_bround(s, d):
    """Quotas of 100 rows over sources and languages, ties to even."""
    rows = table(s, d, DOCS).select(name_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("language"))
    return profile.quotas(rows, 100, "source", "language")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE lower(text) LIKE '%fattura%' OR lower(text) LIKE '%conto n.%' OR lower(text) LIKE '%iban%'")
def first_match(s, d):
    """The first document that speaks of money."""
    return profile.first_match(table(s, d, DOCS), "doc_id", tx.contains_any(F.col("text"), ["fattura", "conto n.", "IBAN"]), "doc_id")


# ---- sets, joins, registry


@query(f"SELECT rec_id, 'train' AS part FROM {TRAIN} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels) UNION ALL SELECT rec_id, 'validation' FROM {VAL} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels)")
def union_sources(s, d):
    """The usable records of two tables."""
    part = lambda n, p: table(s, d, n).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels"))).select("rec_id", F.lit(p).alias("part"))
    return part(TRAIN, "train").unionByName(part(VAL, "validation"))


@query(f"SELECT rec_id FROM {SYN} WHERE template_id IN (SELECT id FROM legal_templates WHERE doc_type IS NOT NULL)")
def semi_select(s, d):
    """Records of typed templates."""
    known = table(s, d, "legal_templates").where("doc_type is not null").select(F.col("id").alias("template_id"))
    return subset.fetch(table(s, d, SYN).select("rec_id", "template_id"), broadcast_within(known), "template_id").select("rec_id")


@query(f"SELECT v.rec_id FROM {VAL} v WHERE v.tokens IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {TRAIN} t WHERE t.tokens = v.tokens)")
def anti_holdout(s, d):
    """Evaluation records whose tokens don't stand in the training table; 256-bit hashes of the token lists meet, no texts."""
    key = lambda n: table(s, d, n).where("tokens is not null").select("rec_id", F.sha2(F.to_json("tokens"), 256).alias("k"))
    return key(VAL).join(key(TRAIN).select("k"), "k", "left_anti").select("rec_id")


@query("WITH v AS (SELECT 'v' || (p_size % 3) || '.' || (p_partkey % 13) || '.' || p_size AS version, p_size % 3 AS a, p_partkey % 13 AS b, p_size AS c FROM part) SELECT arg_max(version, struct_pack(a, b, c, version)) AS version FROM v")
def version_max(s, d):
    """The newest of versions made from parts, by number."""
    v = F.concat(F.lit("v"), F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 13, F.lit("."), F.col("p_size"))
    return registry.newest(table(s, d, "part").select(v.alias("version")), "version")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS version, CASE WHEN n_regionkey = 2 THEN 'again' ELSE 'once' END AS state, CAST(CASE WHEN n_regionkey = 2 THEN 100 + n_nationkey ELSE n_nationkey END AS BIGINT) AS trained_at FROM nation")
def registry_upsert(s, d):
    """Runs of one region entered again."""
    n = table(s, d, "nation")
    row = lambda df, state, plus: df.select(F.col("n_nationkey").cast("string").alias("version"), F.lit(state).alias("state"), (F.col("n_nationkey") + plus).cast("bigint").alias("trained_at"))
    return registry.upsert(row(n, "once", 0), row(n.where("n_regionkey = 2"), "again", 100))


@query(f"WITH l AS (SELECT DISTINCT label FROM (SELECT unnest(bio_labels) AS label FROM {TRAIN} UNION ALL SELECT unnest(bio_labels) FROM {SYN})) SELECT label, CAST(row_number() OVER (ORDER BY label NULLS FIRST) - 1 AS INTEGER) AS id FROM l")
def label_ids(s, d):
    """Ids of all labels of two tables."""
    both = table(s, d, TRAIN).select("bio_labels").unionByName(table(s, d, SYN).select("bio_labels"))
    return registry.numbered_labels(both, "bio_labels")


@query("WITH c AS (SELECT raw_tag, coalesce(map {%s}[raw_tag], raw_tag) AS coarse FROM tag_taxonomy) SELECT raw_tag, coarse FROM c" % ", ".join(f"'{k}': '{v}'" for k, v in taxonomy.COARSE.items()))
def taxonomy_map(s, d):
    """The coarse tag of every tag."""
    return table(s, d, "tag_taxonomy").select("raw_tag", taxonomy.coarse(F.col("raw_tag")).alias("coarse"))


@query(r"SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\{([\p{L}\p{N}_]+)\}', 1), lambda x: NOT list_contains([" + ", ".join(repr(x) for x in generate.SLOTS) + r"], x)))), ' ') AS unknown, CAST(len(regexp_extract_all(text, '\{([\p{L}\p{N}_]+)\}', 1)) AS INTEGER) AS slots FROM legal_templates")
def slot_difference(s, d):
    """Slots of each template, and those without a generator."""
    names = F.array(*[F.lit(x) for x in generate.SLOTS])
    found = tx.slots(F.col("text"))
    return table(s, d, "legal_templates").select("id", F.concat_ws(" ", F.array_sort(F.array_except(found, names))).alias("unknown"), F.size(found).alias("slots"))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT template_id AS a, CAST(len(tokens) AS BIGINT) + 1000000 AS b FROM {SYN} WHERE template_id IS NOT NULL AND tokens IS NOT NULL),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x, x AS c FROM u UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.x)
SELECT CAST(x AS BIGINT) AS node, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY x"""
)
def linked_templates(s, d):
    """Components of templates that share the length of a record."""
    e = table(s, d, SYN).where("template_id is not null and tokens is not null").select(F.col("template_id").cast("bigint").alias("a"), (F.size("tokens").cast("bigint") + 1000000).alias("b"))
    return components(e, "a", "b")


_BOOST = {"CATASTO": 4.0, "ORG": 2.0}


@query(
    r"WITH t AS (SELECT id, regexp_extract_all(text, '\{([\p{L}\p{N}_]+)\}', 1) AS s FROM legal_templates) SELECT id, CASE WHEN list_contains(s, 'CATASTO') THEN 4.0 WHEN list_has_any(s, ['ORG', 'ORGLIST', 'MIXEDLIST']) THEN 2.0 ELSE 1.0 END AS weight FROM t"
)
def template_weights(s, d):
    """The weight of each template when land registers and organisations are boosted."""
    return generate.template_weights(table(s, d, "legal_templates"), "id", "text", _BOOST).select("id", F.col("weight").cast("double").alias("weight"))


@query()
def cleaned_templates(s, d):
    """Templates that can be used: with slots, without unknown ones, without a name written out."""
    rows = table(s, d, "legal_templates")
    known = generate.common_words(rows, "text")
    return rows.select("id", generate.cleaned_template(F.col("text"), common=known).alias("text")).where("text is not null")


_OUTSIDE = taxonomy.OUTSIDE | {"GIVENNAME": "FULLNAME", "SURNAME": "FULLNAME"}


@query(_encoded("map {%s}[e.ent_label]" % ", ".join(f"'{k}': '{v}'" for k, v in _OUTSIDE.items()), "-y.o", "q.before < h.h.a"))
def outside_bio(s, d):
    """Tokens and labels from list literals of spans, made from the synthetic entities."""
    rows = table(s, d, SYN).where("source_text is not null and entities is not null")
    one = F.transform("entities", lambda e: F.concat(F.lit("["), e["ent_start"].cast("string"), F.lit(", "), e["ent_end"].cast("string"), F.lit(", '"), e["ent_label"], F.lit("_1']")))
    literal = F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))
    t, x = bio.encode_outside(F.col("source_text"), literal, _OUTSIDE)
    return rows.select("rec_id", F.concat_ws(" ", t).alias("tokens"), F.concat_ws(" ", x).alias("labels"))


@query("SELECT doc_id, CAST(2 * n AS BIGINT) AS turns FROM (SELECT doc_id, 1 AS n FROM documents)")
def cycled_rows(s, d):
    """How often each document comes in two rounds over all of them."""
    docs = table(s, d, DOCS).select("doc_id")
    return bio.cycle(docs, "doc_id", 2 * docs.count()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("turns"))


_SNIPPETS = {"AGE": ["di anni 44.", "ha {DATE} e anni 61."], "DOCID": ["prot. n. {DOCID}.", "rif. {DOCID};"]}


@query(f"SELECT 'first' AS part, CAST(least(300, count(*)) AS BIGINT) AS rows FROM {TRAIN} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels) UNION ALL SELECT 'second', CAST(least(300, count(*)) AS BIGINT) FROM {VAL} WHERE len(tokens) > 0 AND len(tokens) = len(bio_labels) UNION ALL SELECT 'AGE', 40 UNION ALL SELECT 'DOCID', 40")
def validation_parts(s, d):
    """Rows of each part of a validation set of 300, 300 and 40 for each tag that both tables lack."""
    usable = lambda n: table(s, d, n).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels"))).select("rec_id", "tokens", "bio_labels")
    return corpora.validation_set(usable(TRAIN), usable(VAL), "rec_id", _SNIPPETS, 300, 40).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT t AS type, CAST(count(*) AS BIGINT) AS spans FROM (SELECT unnest(entities).ent_label AS t FROM {SYN} WHERE source_text IS NOT NULL) WHERE t NOT IN ({', '.join(repr(k) for k in taxonomy.OUTSIDE)}) GROUP BY 1")
def dropped_types(s, d):
    """Types that the outside table lacks, from list literals made of the synthetic entities."""
    rows = table(s, d, SYN).where("source_text is not null")
    one = F.transform("entities", lambda e: F.concat(F.lit("["), e["ent_start"].cast("string"), F.lit(", "), e["ent_end"].cast("string"), F.lit(", '"), e["ent_label"], F.lit("_1']")))
    return corpora.dropped_types(rows.select(F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]")).alias("spans")), "spans")


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN template_id > 200 THEN 1 ELSE 0 END) AS BIGINT) AS hits, sum(CASE WHEN template_id > 200 THEN 1 ELSE 0 END) / count(*) AS share FROM {SYN}")
def new_template_share(s, d):
    """Share of the synthetic records that come from the templates added last."""
    return corpora.share_of(table(s, d, SYN), F.col("template_id") > 200)


@query(SQL["validated_rate"])
def validated_rate_sql(s, d):
    """The same rates by the session's SQL functions."""
    register(s)
    table(s, d, SYN).select(F.explode("entities").alias("e")).createOrReplaceTempView("cartula_gold")
    return s.sql(
        """SELECT label, count(1) AS n, sum(CASE WHEN ok THEN 1L ELSE 0L END) AS passed, sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(1) AS rate FROM (
        SELECT e.ent_label AS label, CASE e.ent_label WHEN 'CF' THEN cf_exact(e.ent_value) WHEN 'PIVA' THEN piva_exact(e.ent_value) ELSE iban_exact(e.ent_value) END AS ok
        FROM cartula_gold WHERE e.ent_label IN ('CF', 'PIVA', 'IBAN')) GROUP BY label"""
    )


# ---- generation and sampling: no SQL, for values come by hash; tests hold their properties


@query()
def generated_rows(s, d):
    """A synthetic record for each customer from the legal templates."""
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("rec_id"))
    return generate.corpus(keys, "rec_id", table(s, d, "legal_templates").select("id", "text"), {"CATASTO": 4.0, "ORG": 2.0})


_PLAIN = "substr(source_text, e.ent_start + 1, e.ent_end - e.ent_start)"


@query(
    f"""WITH r AS (SELECT rec_id, len(tokens) AS a, len(bio_labels) AS b, source_text, entities FROM {SYN}),
x AS (SELECT rec_id, generate_subscripts(entities, 1) AS i, unnest(entities) AS e, source_text FROM r),
y AS (SELECT rec_id, i, e.ent_label AS label, e.ent_value AS value, {_PLAIN} AS found FROM x),
z AS (SELECT rec_id, i, CASE WHEN found IS DISTINCT FROM value THEN 'offset'
 WHEN label = 'CF' AND NOT coalesce(regexp_full_match(value, '[0-9A-Z]{{15}}[A-Z]') AND chr(CAST(65 + {_CF_SUM} % 26 AS INTEGER)) = substr(value, 16, 1), FALSE) THEN 'CF'
 WHEN label = 'PIVA' AND NOT coalesce(regexp_full_match(value, '[0-9]{{11}}') AND (10 - {_VAT.format("CASE WHEN regexp_full_match(value, '[0-9]{11}') THEN value ELSE '00000000000' END")} % 10) % 10 = TRY_CAST(substr(value, 11, 1) AS INTEGER), FALSE) THEN 'PIVA'
 WHEN label = 'IBAN' AND NOT coalesce(regexp_full_match(value, '[0-9A-Z]+') AND {_MOD97.format("CASE WHEN regexp_full_match(value, '[0-9A-Z]+') THEN substr(value, 5) || substr(value, 1, 4) ELSE '0' END")} = 1, FALSE) THEN 'IBAN' END AS w FROM y),
f AS (SELECT rec_id, arg_min(w, i) AS w FROM z WHERE w IS NOT NULL GROUP BY 1)
SELECT r.rec_id, CASE WHEN r.a IS DISTINCT FROM r.b THEN 'length' ELSE f.w END AS error FROM r LEFT JOIN f USING (rec_id) WHERE r.a IS DISTINCT FROM r.b OR f.w IS NOT NULL"""
)
def record_errors(s, d):
    """The first thing wrong with each synthetic record."""
    rows = table(s, d, SYN).withColumn("entities", F.transform("entities", lambda e: F.struct(e["ent_value"].alias("value"), e["ent_label"].alias("label"), e["ent_start"].alias("start"), e["ent_end"].alias("end"))))
    return generate.self_check(rows).where("error is not null").select("rec_id", "error")


@query("SELECT CAST(NULL AS BIGINT) AS rec_id, CAST(NULL AS VARCHAR) AS error WHERE FALSE")
def generated_errors(s, d):
    """What the self-check finds wrong with the generated records: nothing."""
    return generate.self_check(generated_rows(s, d)).where("error is not null").select("rec_id", "error")


@query()
def augmented_rows(s, d):
    """Training records with one or two snippets spliced in."""
    rows = table(s, d, TRAIN).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels"))).select("rec_id", "tokens", "bio_labels")

    def snippet(i: int):
        draw = generate.Draw(F.col("rec_id"), F.lit(f"snippet{i}"))
        t, x = bio.encode(F.concat(F.lit("prot. n. "), F.get(generate.act(draw), F.lit(0))["text"]), F.array(F.struct(F.lit("DOCID").alias("label"), F.lit(9).alias("start"), F.lit(1000).alias("end"))))
        return F.when(F.lit(i == 0) | (tx.uniform(F.col("rec_id"), F.lit("two")) < 0.5), F.struct(t.alias("tokens"), x.alias("labels")))

    return bio.augment(rows, "rec_id", "tokens", "bio_labels", [snippet(0), snippet(1)])


@query()
def recased_rows(s, d):
    """Training records with recased tokens."""
    rows = table(s, d, TRAIN).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels")))
    return subset.recase(rows.select("rec_id", "tokens", taxonomy.normalised(F.col("bio_labels")).alias("bio_labels")), "rec_id", "tokens", "bio_labels")


@query()
def stratified_subset(s, d):
    """A subset of a fifth of the rows with floors for rare tags."""
    rows = table(s, d, SUB).where(taxonomy.valid(F.col("tokens"), F.col("bio_labels")))
    index = rows.select("rec_id", taxonomy.tags_of(taxonomy.normalised(F.transform("bio_labels", lambda x: F.upper(x)))).alias("tags"), name_key(F.col("source")).alias("source"), language_key(F.col("language")).alias("language"))
    return subset.select(index, "rec_id", "tags", ["source", "language"], max(1, index.count() // 5), floors={"TARGA": 20, "CREDITCARDNUMBER": 20}, floor=5)


@query()
def shuffled_sample(s, d):
    """A tenth of the records, in seeded order (a sampling operator)."""
    rows = table(s, d, TRAIN).select("rec_id")
    return subset.shuffled(rows, "rec_id", rows.count() // 10)


@query(f"SELECT t.template_id, CAST(least(t.n, 3) AS BIGINT) AS picked FROM (SELECT template_id, count(*) AS n FROM {SYN} GROUP BY 1) t")
def picked_per_template(s, d):
    """How many records a pick of three for each template gives."""
    rows = table(s, d, SYN).select("rec_id", "template_id")
    quota = rows.select("template_id").distinct().withColumn("k", F.lit(3))
    got = ranking.pick_per_group(rows, quota, ["template_id"], "k", [F.xxhash64("rec_id"), F.col("rec_id")])
    return got.groupBy("template_id").agg(F.count(F.lit(1)).alias("picked"))


@query(f"SELECT rec_id, CASE WHEN len(tokens) <> len(bio_labels) OR (tokens IS NULL) <> (bio_labels IS NULL) THEN 'length' END AS error FROM {SYN} WHERE len(tokens) <> len(bio_labels) OR (tokens IS NULL) <> (bio_labels IS NULL)")
def records_of_unequal_length(s, d):
    """Synthetic records whose arrays are not equally long."""
    rows = table(s, d, SYN).withColumn("entities", F.transform("entities", lambda e: F.struct(e["ent_value"].alias("value"), e["ent_label"].alias("label"), e["ent_start"].alias("start"), e["ent_end"].alias("end"))))
    return generate.self_check(rows).where("error = 'length'").select("rec_id", "error")
