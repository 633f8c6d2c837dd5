"""Every query of the core against its SQL in DuckDB on the smallest tables; those without SQL by their invariants."""

import math
import os

import duckdb
import plain
import pytest

from cartula import catalog


def norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(catalog.SQL[name])
    at = {d[0]: i for i, d in enumerate(res.description)}
    assert sorted(at) == cols
    assert got == sorted((tuple(norm(r[at[c]]) for c in cols) for r in res.fetchall()), key=repr)


def test_encoding_and_decoding_agree_with_plain_python(spark, data):
    rows = {r["rec_id"]: r for r in catalog.QUERIES["bio_encode"](spark, data).collect()}
    syn = spark.read.parquet(f"{data}/synthetic_pii_it_200k.parquet").collect()
    for r in syn:
        if r["source_text"] is None or r["entities"] is None:
            continue
        import re

        toks = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", r["source_text"])]
        labels = []
        for _, a, b in toks:
            e = next((e for e in r["entities"] if a >= e["ent_start"] and b <= e["ent_end"]), None)
            labels.append("O" if e is None else ("B-" if a == e["ent_start"] else "I-") + e["ent_label"])
        assert rows[r["rec_id"]]["tokens"] == " ".join(t[0] for t in toks)
        assert rows[r["rec_id"]]["labels"] == " ".join(labels)


def test_decoding_of_odd_sequences(spark):
    from pyspark.sql import functions as F

    from cartula.operators import bio

    cases = ["B-A B-A O I-A I-B I-B B-B O", "O", "", "I-A I-A", "B-A I-B B-B I-B"]
    df = spark.createDataFrame([(i, c.split()) for i, c in enumerate(cases)], "i int, x array<string>")
    got = {r["i"]: {tuple(s) for s in r["s"]} for r in df.select("i", bio.decode(F.col("x")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [plain.spans(c.split()) for c in cases]
    rows = bio.decode_rows(df, "i", "x").collect()
    for i, c in enumerate(cases):
        assert {(r["type"], r["s"], r["e"]) for r in rows if r["i"] == i} == plain.spans(c.split())


def test_generated_rows_hold_their_invariants(spark, data):
    rows = catalog.generated_rows(spark, data)
    from cartula.operators.generate import self_check

    assert self_check(rows).where("error is not null").count() == 0
    got = rows.limit(40).collect()
    assert got and all(len(r["tokens"]) == len(r["bio_labels"]) for r in got)
    again = {r["rec_id"]: r["source_text"] for r in catalog.generated_rows(spark, data).collect()}
    assert all(again[r["rec_id"]] == r["source_text"] for r in got)


def test_augmented_and_recased_rows(spark, data):
    before = {r["rec_id"]: r for r in spark.read.parquet(f"{data}/deepmount_pii_it_train.parquet").collect()}
    for r in catalog.QUERIES["augmented_rows"](spark, data).collect():
        assert len(r["tokens"]) == len(r["bio_labels"]) > len(before[r["rec_id"]]["tokens"])
        assert "B-DOCID" in r["bio_labels"]
    for r in catalog.QUERIES["recased_rows"](spark, data).collect():
        assert [t.lower() for t in r["tokens"]] == [t.lower() for t in before[r["rec_id"]]["tokens"]]
