"""Names, ranks, components, subsets, sources, streaming and text functions on small fixtures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cartula.functions import checksums as ck
from cartula.functions import guards
from cartula.functions import text as tx
from cartula.functions.sql import register
from cartula.functions.names import language_key, name_key, spelling
from cartula.operators import bio, evaluate, generate, profile, registry, subset, taxonomy, windows
from cartula.operators.components import components
from cartula.operators.ranking import hashed_rank, pick_per_group
from cartula.plans import corpora, lineage
from cartula.sources import jsonl
from cartula.streaming.anonymize import start


def test_names(column):
    same = ["Portale_Sentenze", " portale sentenze ", "PORTALE-SENTENZE", "portalesentenze", "portale_sentenze.jsonl", "portale//sentenze/", "Portale–Sentenze.JSONL/"]
    assert set(column(same, name_key(F.col("x")))) == {"portalesentenze"}
    assert column([None, "", " ", "?", "n/d", "N/D", "-", "null", "sconosciuta"], name_key(F.col("x"))) == [None] * 9
    assert column(["Synth augment", "ai4.jsonl"], spelling(F.col("x"))) == ["synth_augment", "ai4"]
    assert column(["it", "It ", "ITA", "it-IT", " fr", "en_GB", "ger", "nl-NL", None, "", "?", "n/d"], language_key(F.col("x"))) == ["it", "it", "it", "it", "fr", "en", "de", "nl", None, None, None, None]


def test_ranks_are_dense_and_seeded(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    order = [F.xxhash64("id"), F.col("id")]
    got = hashed_rank(rows, ["g"], order, "r").collect()
    for g in ("hot", None):
        assert sorted(r["r"] for r in got if r["g"] == g) == list(range(1, 1 + sum(r["g"] == g for r in got)))
    quota = spark.createDataFrame([("hot", 7), (None, 2)], "g string, k int")
    picked = pick_per_group(rows, quota, ["g"], "k", order).collect()
    assert sorted(str(r["g"]) for r in picked) == ["None"] * 2 + ["hot"] * 7
    assert {r["id"] for r in picked} == {r["id"] for r in got if r["r"] <= {"hot": 7, None: 2}[r["g"]]}
    assert hashed_rank(rows.limit(0), ["g"], order).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (999, 999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a int, b int")
    for few in (0, 1000):  # on the whole cluster, in one task
        assert {r[0]: r[1] for r in components(df, "a", "b", few).collect()} == {x: find(x) for x in list(parent)}
        assert components(df.limit(0), "a", "b", few).count() == 0


def test_lookup_of_hot_and_missing_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(600)], "id int, k string")
    small = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 600, 4)]], "k string, v int")
    want = {i: 1 if i % 3 else None if i % 2 or i % 4 else i for i in range(600)}
    for bound in (50_000, 5):
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", bound)
        got = lineage.lookup(rows, small, "k").collect()
        assert {r["id"]: r["v"] for r in got} == want and len(got) == 600


def test_no_checkpoints_on_a_machine_s_own_disk(monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.checkpoint_folder(Cluster)


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (120, 1), (121, 2), (220, 2), (221, 3)])
def test_windows(column, n, want):
    text = "  " + " ".join(f"w{i}" for i in range(n)) + " "
    got = column([text], windows.windows(F.col("x")))[0]
    assert len(got) == want
    assert all(text[w["offset"] : w["offset"] + len(w["text"])] == w["text"] for w in got)
    if n:
        assert got[-1]["text"].endswith(f"w{n - 1}")


def test_text_functions(column):
    x = F.col("x")
    assert column(["C.F.", "नमस्ते x²", "a_b 😀", None, ""], tx.tokens(x))[:3] == [["C", ".", "F", "."], ["नमस", "्", "त", "े", "x²"], ["a_b", "😀"]]
    assert column(["a {X} b{Y}{Z}"], F.transform(tx.parts(x), lambda p: F.coalesce(p["slot"], p["text"]))) == [["a ", "X", " b", "Y", "Z"]]
    odd = ["  Straße\n x ", "ΣΑΣ", "İstanbul", "ﬁne", "ŉ", "abc", "", None, "😀 É", "ᏸ"]
    assert column(odd, tx.same_value(x)) == [None if v is None else " ".join(v.split()).casefold() for v in odd]
    assert column(["a\ufdd0b c"], F.transform(tx.matches(x, r"\S+"), lambda m: m["value"])) == [["a\ufdd0b", "c"]]
    assert column(["[ID_DOC_12]", "x"], tx.label_of(x)) == ["ID_DOC", ""]
    assert column(["A<b>&"], tx.escape_html(x)) == ["A&lt;b&gt;&amp;"]
    assert column(["FIRSTNAME_1"], tx.without_suffix(x)) == ["FIRSTNAME"]
    assert column(["ORG=6 iban=2.5", "X"], tx.weights(x)) == [{"ORG": 6.0, "IBAN": 2.5}, {"X": None}]
    assert column(["😀"], tx.hue(x)) == [(0xD83D * 31 + 0xDE00) % 360]
    assert column(["FULLNAME"], tx.hue(x)) == [__import__("functools").reduce(lambda h, c: (h * 31 + ord(c)) % 360, "FULLNAME", 0)]
    assert column(["\x1c ab  "], tx.lead(x)) == [2] and column(["ab \x1f"], tx.tail(x)) == [2]


def test_outside_spans(spark):
    df = spark.createDataFrame([("Anna Bianchi paga", "[[0, 4, 'FIRSTNAME_1'], [5, 12, 'LASTNAME_2'], [13, 17, 'JOB_1']]")], "t string, s string")
    t, x = bio.encode_outside(F.col("t"), F.col("s"))
    assert df.select(t, x).first() == (["Anna", "Bianchi", "paga"], ["B-FULLNAME", "B-FULLNAME", "O"])


def test_normalised(column):
    got = column(["B-GIVENNAME B-SURNAME O B-PEC O B-TITLE", "", "O"], taxonomy.normalised(F.split("x", " ")))
    assert got[0] == "B-FULLNAME I-FULLNAME O B-EMAIL O O".split()


def test_quality(spark):
    df = spark.createDataFrame([("B-A I-A O B-B".split(), "B-A I-A O B-C".split()), ("O B-A".split(), "O O".split())], "g array<string>, p array<string>")
    per = {r["type"]: r for r in evaluate.per_tag(df, "g", "p").collect()}
    assert (per["A"]["tp"], per["A"]["fn"], per["C"]["fp"], per["B"]["fn"]) == (1, 1, 1, 1)
    s = evaluate.summary(evaluate.per_tag(df, "g", "p")).first()
    assert (s["precision"], round(s["recall"], 6), s["support"]) == (0.5, round(1 / 3, 6), 3)
    assert round(s["macro_f1"], 6) == round((2 / 3 + 0) / 2, 6)  # C has no support
    assert evaluate.summary(evaluate.per_tag(df.limit(0), "g", "p")).first()["f1"] == 0.0
    assert evaluate.token_accuracy(df, "g", "p").first()["correct"] == 4


def test_quota_ties_go_to_even(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 7 + [("c",)] * 8, "k string")
    assert {r["k"]: r["quota"] for r in profile.quotas(df, 10, "k").collect()} == {"a": 2, "b": 4, "c": 4}


def test_subset_floors_and_size(spark):
    rnd = random.Random(2)
    rows = [(i, [t for t, p in (("A", 0.6), ("B", 0.1), ("C", 0.02)) if rnd.random() < p], rnd.choice("xxxy")) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, s string")
    got = {r[0] for r in subset.select(df, "id", "tags", ["s"], 100, floors={"B": 30}, floor=8).collect()}
    assert len(got) == 100
    tags = dict((i, t) for i, t, _ in rows)
    for tag, floor in (("A", 8), ("B", 30), ("C", 8)):
        assert sum(tag in tags[i] for i in got) >= min(floor, sum(tag in t for t in tags.values()))
    assert subset.select(df, "id", "tags", ["s"], 9999).count() == 600
    assert subset.select(df.limit(0), "id", "tags", ["s"], 10).count() == 0


def test_versions(spark):
    df = spark.createDataFrame([("m-1.9.0",), ("m-1.10.0",), ("latest",), (None,)], "v string")
    assert registry.newest(df, "v").first()[0] == "m-1.10.0"


def test_stray_names_and_templates(column):
    x = F.col("x")
    texts = ["Il Sig Bianchi vive", "Il Sig. Bianchi vive", "paga Mario Rossi a {CITY}", "Il Tribunale Civile di {CITY}", "niente"]
    common = ["Il", "Tribunale", "Civile"]
    assert [len(s) for s in column(texts, generate.stray_names(x, common))] == [1, 0, 1, 0, 0]
    fenced = ["```\nil {CITY}\n```", "il {NOPE}", "niente", None, "di Mario Rossi {CITY}"]
    assert column(fenced, generate.cleaned_template(x)) == ["il {CITY}", None, None, None, None]


def test_common_words_come_from_templates(spark):
    rows = [("Il Tribunale di {CITY}",), ("Il Tribunale civile",), ("Al Tribunale va Bianchi",), ("Il Civile",), (None,)]
    assert generate.common_words(spark.createDataFrame(rows, "text string"), "text") == ["Civile", "Di", "Il", "Tribunale", "Va"]
    assert generate.common_words(spark.createDataFrame([], "text string"), "text") == []


def test_drawn_names_and_numbers(spark):
    rows = spark.range(300)
    d = lambda what: generate.Draw(F.col("id"), F.lit(what))
    got = rows.select(generate.act(d("a")).alias("a"), generate.docket(d("b")).alias("b"), generate.land_register(d("c")).alias("c"), generate.organisation_name(d("d")).alias("d")).collect()
    assert {re.sub("[0-9]", "#", re.sub("[A-Z]", "@", r["a"][0]["text"])) for r in got} == {"####-####", "@@ ######", "####.#", "###/@/####"}
    assert all(re.fullmatch("[1-9][0-9]{1,4}/20[0-9]{2}", r["b"][0]["text"]) for r in got)
    assert {sum(p["label"] == "CATASTO" for p in r["c"]) for r in got} == {2, 3}
    assert all(r["d"] for r in got) and len({r["d"] for r in got}) > 150


def test_weights_and_choice(spark):
    t = spark.createDataFrame([(1, "{ORG} e {CITY}"), (2, "{CITY}"), (3, "{JUDGE}")], "id int, text string")
    w = {r["id"]: r["weight"] for r in generate.template_weights(t, "id", "text", {"ORG": 6.0, "FULLNAME": 2.0}).collect()}
    assert w == {1: 6.0, 2: 1.0, 3: 2.0}
    rows = generate.weighted_choice(spark.range(3000), "id", spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "o string, weight double"), "o")
    n = {r["o"]: r["count"] for r in rows.groupBy("o").count().collect()}
    assert set(n) == {"a", "b"} and 2100 < n["a"] < 2400


def test_cycle(spark):
    rows = spark.createDataFrame([(10, "x"), (30, "z"), (20, "y")], "k int, v string")
    assert [r["v"] for r in bio.cycle(rows, "k", 7).orderBy("turn").collect()] == list("xyzxyzx")
    assert bio.cycle(rows.limit(0), "k", 7).count() == 0


def test_sources(spark, tmp_path):
    a, b, t = tmp_path / "a.jsonl", tmp_path / "b.jsonl", tmp_path / "t.json"
    a.write_text("\n".join(json.dumps(x) for x in [{"language": "it", "mbert_tokens": ["a"], "mbert_token_classes": ["B-SURNAME"]}, {"language": "en", "mbert_tokens": ["b"], "mbert_token_classes": ["O"]}, {"language": "", "mbert_tokens": ["c"], "mbert_token_classes": ["O"]}, {"language": "it", "mbert_tokens": [], "mbert_token_classes": []}]))
    b.write_text("\n".join(json.dumps(x) for x in [{"tokens": ["d"], "bio_labels": ["O"]}, {"tokens": ["e", "f"], "bio_labels": ["O"]}]))
    t.write_text(json.dumps([{"id": 1, "text": "{CITY}"}, {"id": 2, "text": "{NOPE}"}, {"id": 3, "text": "x"}]))
    assert jsonl.outside(spark, str(a), "it").collect() == [(["a"], ["B-FULLNAME"], "it")]
    assert jsonl.outside(spark, str(a), limit=2).count() == 2
    assert jsonl.training(spark, str(b)).count() == 1 and jsonl.strict(spark, str(b)).count() == 1
    files = [{"path": str(a), "schema": "outside", "source": "A"}, {"path": str(b), "schema": "training", "source": "B"}, {"path": str(tmp_path / "no.jsonl"), "schema": "training", "source": "C"}]
    assert sorted((r["source"], r["language"]) for r in jsonl.pool(spark, files).collect()) == [("A", "?"), ("A", "en"), ("A", "it"), ("B", "it")]
    assert [r["id"] for r in jsonl.templates(spark, str(t)).collect()] == [1] and jsonl.templates(spark, str(tmp_path / "no.json")).count() == 0
    jsonl.write(jsonl.training(spark, str(b)), str(tmp_path / "out"))
    assert jsonl.training(spark, str(tmp_path / "out")).collect() == [(["d"], ["O"])]


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([("B-A I-A O B-B".split(), "B-A I-A O B-C".split())], "g array<string>, p array<string>")
    tags = evaluate.per_tag(df, "g", "p")
    jsonl.write_report(evaluate.summary(tags), tags, str(tmp_path))
    got = spark.read.json(str(tmp_path / "metrics")).first()
    assert got["precision"] == 0.5 and [r["type"] for r in got["per_tag"]] == ["A", "B", "C"]
    assert spark.read.text(str(tmp_path / "text")).count() == 3


def test_guards():
    assert guards.rows_asked(1) == 1 and guards.handle(" Anna.B-1_x ") == "AnnaB-1_x"
    for bad in (0, 200_001):
        with pytest.raises(ValueError):
            guards.rows_asked(bad)
    with pytest.raises(ValueError):
        guards.handle(" ./ ")


def test_sql_functions_equal_columns(spark):
    register(spark)
    values = ["RSSMRA85M01H501Q", "rssmra85m01h501q ", "12345678903", "1234567890 3", "00000000000", "IT60X0542811101000000123456", "it60 x0542811101000000123456", "4111 1111 1111 1111", "", "x", None]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for name in ("cf_exact", "cf_ok", "piva_exact", "piva_ok", "iban_exact", "iban_ok", "luhn_ok"):
        got = df.select(F.expr(f"{name}(x)").alias("a"), getattr(ck, name)(F.col("x")).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got], name


def test_validation_set_and_snippets(spark):
    rows = spark.createDataFrame([(i, ["Fine", ".", f"w{i}"], ["O", "O", "B-CITY"]) for i in range(6)], "k int, tokens array<string>, bio_labels array<string>")
    got = corpora.validation_set(rows, rows.where("k < 2"), "k", {"DOCID": ["n. {DOCID}."]}, 4, 5).collect()
    assert {p: sum(r["part"] == p for r in got) for p in ("first", "second", "DOCID")} == {"first": 4, "second": 2, "DOCID": 5}
    for r in got:
        assert len(r["tokens"]) == len(r["bio_labels"]) and ("B-DOCID" in r["bio_labels"]) == (r["part"] == "DOCID") and "B-CITY" in r["bio_labels"]
    more = corpora.enriched(rows, "k", {"A": ["x."], "B": ["y."]}, 14).collect()
    assert sorted(r["turn"] for r in more) == list(range(14)) and {len(r["tokens"]) for r in more} == {5, 7}
    assert corpora.enriched(rows, "k", {}, 3).count() == corpora.enriched(rows.limit(0), "k", {"A": ["x."]}, 3).count() == 0
    assert corpora.share_of(rows.limit(0), F.col("k") > 1).first()["share"] == 0.0


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([("scrivi a a@b.it",), (None,), ("",)], "x string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string").parquet(str(tmp_path / "in"))
    start(stream, "x", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(str(r["anonymized_text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "None", "scrivi a [EMAIL_1]"]
