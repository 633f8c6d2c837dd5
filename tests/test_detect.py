"""Detectors, merge, placeholders and restoring against plain Python on fixtures, noise and whole documents."""

import random

import pandas as pd
import plain
import pytest
from pyspark.sql import functions as F

from cartula.functions import checksums as ck
from cartula.operators import detect, spans
from cartula.operators.detect import Candidates
from cartula.plans.analysis import analyse, from_json, to_json, with_model

TEXTS = [
    "IBAN IT60X0542811101000000123456", "IT60 X054 2811 1010 0000 0123 456", "RSSMRA85M01H501Q", "RSSMRA85M01H501Z", "12345678903", "12345678901",
    "00000000000", "4111 1111 1111 1111  fine", "€ 12.500,00", "1.234,56 euro", "EUR 5", "NEURO 8", "+39 333 1234567", "3331234567", "02 1234567", "é333 1234567",
    "AB123CD AB 123 CD", "€ 12,00", "😀 a@b.it 😀 c@d.it", "a@b.it … A@B.IT … a@b.it  3331234567", "", " \t", "١٢ x", "**a@b.it** e **c@d.it**",
    "Il sig. Rossi, a@b.it, paga € 1.000,00 e ancora € 1.000,00 al 12345678903", "x" * 5000 + " a@b.it",
]


def noise(n=400, seed=7):
    rnd = random.Random(seed)
    atoms = ["RSSMRA85M01H501Q", "IT60X0542811101000000123456", "4111111111111111", "12345678903", "a.b@c.it", "AB123CD", "333 123 4567", "€ 1.234,56", "12,50 EUR", "é", "́", "²", "٣", "\x1c", " ", "😀", "№", " ", ".", "-", "x", "1", "_", "\n", "euro"]
    return ["".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def test_candidates_and_spans_equal_plain_python(spark, data):
    docs = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r[0]]
    texts = TEXTS + noise() + docs
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "x": texts}))
    got = analyse(df.withColumn("c", detect.candidates(F.col("x"))), "x").orderBy("i").collect()
    for r in got:
        want = plain.found(r["x"])
        assert [(c["label"], c["start"], c["end"], c["score"], c["validated"], c["source"]) for c in r["c"]] == want, repr(r["x"])[:200]
        keep = plain.kept(want, r["x"])
        marks, values = plain.numbered(keep, r["x"])
        assert r["anonymized_text"] == plain.replaced(keep, marks, r["x"])
        assert r["masked_text"] == plain.replaced(keep, [f"[{k[0]}]" for k in keep], r["x"])
        assert r["mapping"] == values and r["n_unique"] == len(values) and r["n_entities"] == len(keep)
        assert "".join(s["t"] for s in r["segments"]) == r["x"]
        assert sum(r["by_label"].values()) == len(keep)


def test_null_and_empty_texts(spark):
    r = analyse(spark.createDataFrame([(None,), ("",)], "x string"), "x").collect()
    assert r[0]["anonymized_text"] is None and r[0]["n_entities"] is None
    assert r[1]["anonymized_text"] == "" and r[1]["n_entities"] == 0 and r[1]["mapping"] == {} and r[1]["n_chunks"] == 0


@pytest.mark.parametrize("name", ["cf", "piva", "iban", "luhn"])
def test_checks(column, name):
    values = [v for v in TEXTS + noise(150, 3) if v.isascii()] + [" rssmra85m01h501q ", "it60x0542811101000000123456", "4111-1111-1111-1111", "1" * 20]
    assert column(values, getattr(ck, name + "_ok")(F.col("x"))) == [getattr(plain, name)(v) for v in values]


def test_exact_checks_don_t_clean(column):
    assert column(["rssmra85m01h501q", "RSSMRA85M01H501Q", ""], ck.cf_exact(F.col("x"))) == [False, True, False]
    assert column(["1234567890 3", "12345678903"], ck.piva_exact(F.col("x"))) == [False, True]
    assert column(["IT60 X0542811101000000123456", "IT60X0542811101000000123456"], ck.iban_exact(F.col("x"))) == [False, True]


def test_built_identifiers_pass(column):
    numbers = [f"{i * 7919 % 10**10:010d}" for i in range(50)]
    assert all(map(plain.piva, column(numbers, ck.piva_build(F.col("x")))))
    assert all(map(plain.iban, column(numbers, ck.iban_build(F.substring("x", 1, 5), F.substring("x", 6, 5), F.concat(F.lit("00"), "x")))))
    code = ck.cf_build(F.lit("Niccolò"), F.lit("D'Amì"), F.lit("F"), F.lit(1985), F.lit(8), F.lit(1), F.lit("H501"))
    assert column(["x"], code)[0][:15] == "DMANCL85M41H501" and plain.cf(column(["x"], code)[0])


def test_accents(column):
    assert len(ck._MARKED) == len(ck._PLAIN)
    names = ["Niccolò", "D'Amì", "Żółć", "Ångström-Ünal", "Ñandú", "Straße", "ﬁloﬃ", "Ǆordan", "№ 5", "Ａｂ"]
    assert column(names, ck.strip_accents(F.col("x"))) == [plain.plain_letters(n) for n in names]


def test_merge_on_random_candidates(spark):
    rnd = random.Random(1)
    text = "ab  cd ef  gh   ij kl mn " * 2
    rows, want = [], []
    for i in range(300):
        cands = []
        for _ in range(rnd.randint(0, 9)):
            a = rnd.randint(0, 40)
            cands.append((rnd.choice("XYZ"), a, a + rnd.randint(1, 8), rnd.choice([0.5, 0.9, 1.0]), rnd.random() < 0.3, rnd.choice(["regex", "model"])))
        rows.append((i, text, [(*c, k) for k, c in enumerate(cands)]))
        want.append(plain.kept(cands, text))
    df = spark.createDataFrame(rows, f"i int, x string, c {Candidates}")
    got = [r[0] for r in df.orderBy("i").select(spans.merge(F.col("c"), F.col("x"))).collect()]
    # equal starts can't remain, so the order is fixed
    assert [[(c["label"], c["start"], c["end"], c["score"], c["validated"], c["source"]) for c in g] for g in got] == want


RESTORE = [
    ("a [X_1] b", {"[X_1]": "VAL"}), ("**[X_1]** b", {"[X_1]": "VAL"}), ("[ X_1 ].", {"[X_1]": "VAL"}), ("a X_1 b", {"[X_1]": "VAL"}), ("X_10", {"[X_1]": "VAL"}),
    ("[X_1] [X_10]", {"[X_1]": "a$1\\b", "[X_10]": "c.d*"}), ("niente", {}), ("", {"[X_1]": "v"}),
]


def test_restore(spark):
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(RESTORE)], "i int, x string, m map<string,string>")
    got = [r[0] for r in df.orderBy("i").select(spans.restore(F.col("x"), F.col("m"))).collect()]
    assert got == [plain.restored(t, m) for t, m in RESTORE]
    exact = [r[0] for r in df.orderBy("i").select(spans.restore_exact(F.col("x"), F.col("m"))).collect()]
    assert exact[3] == "a X_1 b" and exact[4] == "X_10" and exact[5] == "a$1\\b c.d*" and exact[0] == "a VAL b"


def test_round_trip(spark):
    texts = ["scrivere a a.b@c.it o a d@e.it, € 10,00", "niente", "12345678903 e 12345678903"]
    df = analyse(spark.createDataFrame([(t,) for t in texts], "x string"), "x")
    back = df.select("x", spans.restore(F.col("anonymized_text"), from_json(to_json(F.col("mapping")))).alias("y"), spans.restore_exact(F.col("anonymized_text"), F.col("mapping")).alias("z")).collect()
    assert all(r["x"] == r["y"] == r["z"] for r in back)


def test_number_rows_equals_number(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "text")
    whole = docs.select("doc_id", spans.number(spans.merge(detect.candidates(F.col("text")), F.col("text")), F.col("text")).alias("n"))
    rows = whole.select("doc_id", F.inline("n"))
    again = spans.number_rows(rows.drop("ph"), "doc_id").select("doc_id", "start", "ph")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.select("doc_id", "start", "ph").collect()))


def test_model_spans_lose_to_checked_ones(spark):
    def model():
        def find(texts):
            return [[("ORG", t.index("IT60"), t.index("IT60") + 6, 0.99)] if "IT60" in t else ([("NAME", t.index("Rossi"), t.index("Rossi") + 5, 0.8)] if "Rossi" in t else []) for t in texts]

        return find

    df = spark.createDataFrame([(1, "conto IT60X0542811101000000123456"), (2, "il sig. Rossi paga"), (3, None), (4, " ")], "id int, x string")
    got = {r["id"]: r for r in analyse(with_model(df, "id", "x", model), "x", "candidates").collect()}
    assert got[1]["anonymized_text"] == "conto [IBAN_1]" and got[2]["anonymized_text"] == "il sig. [NAME_1] paga"
    assert got[2]["by_source"] == {"model": 1} and got[3]["anonymized_text"] is None and got[4]["anonymized_text"] == " "


def test_no_python_and_no_shuffle_on_the_way(spark):
    df = analyse(spark.createDataFrame([("a@b.it",)], "x string"), "x").select("anonymized_text", "mapping")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
