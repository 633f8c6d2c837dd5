"""The operators for training data against brute force, exact round trips and small odd inputs."""

import collections
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartula.llm import boundaries, budget, calibration, chunks, leakage, mixture, queries, splits, tokenizer, truncation

TOK = tokenizer.TOKENIZERS + "/" + tokenizer.BYTE_BPE_50K
ODD_TEXTS = [None, "", " ", "\n\n  x", "a" * 3000, "ab" * 4000, "😀é²½ ́x\x1c\x85 y", "<|endoftext|>", "it's we'll 'D", "नमस्ते తెలుగు", "x" + " " * 300 + "y", "!" * 700, "﷐"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOK)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# ---- 6


def test_ids_equal_the_library_on_documents(spark, data, public):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, data).collect()}
    assert got == {k: public(t) for k, t in docs.items()}


def test_ids_of_odd_texts(spark, public):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD_TEXTS)], "k int, text string, ids string")
    assert {r["k"]: r["ids"] for r in tokenizer.encode_corpus(df, "k", "text").collect()} == {i: public(t) for i, t in enumerate(ODD_TEXTS)}
    assert tokenizer.encode_corpus(df.limit(0), "k", "text").count() == 0
    n = tokenizer.count_tokens(df.select("k", "text"), "text").collect()
    assert {r["k"]: r["n_tokens"] for r in n} == {i: len(public(t)) for i, t in enumerate(ODD_TEXTS)}


def test_noise_and_pair_checks(public):
    bpe = tokenizer.ByteBpe(open(TOK, "rb").read())
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abehinrtso  '.1éЖ") for _ in range(80)) for _ in range(500)]
    assert bpe.encode(texts) == [public(t) for t in texts]
    words = {v: k for k, v in bpe.ids.items()}
    a, b = (np.array([rnd.choice(list(words)) for _ in range(3000)]) for _ in range(2))
    assert bpe.fits(a, b).tolist() == [bpe.merge(words[x] + words[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


# ---- 1


def words(tokens):
    out = []
    for t in tokens or []:
        if t and t.startswith("##") and len(t) > 2 and out:
            out[-1] += t[2:]
        elif t is not None:
            out.append(t)
    plain = ["".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if c.isalnum()) for w in out]
    return [w for w in plain if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(train, val):
    near = lambda a, b: a and b and distance(a, b) <= max(len(a), len(b)) // 5
    return {(i, j) for i, a in train for j, b in val if near(words(a), words(b))}


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(9)
    vocab = ["il", "La", "è", "casa", "Roma", "n", ".", ",", "##le", "12", "via", None] + [f"w{i}" for i in range(25)]
    train = [(i, [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]) for i in range(60)]
    val = []
    for j in range(80):
        base = list(rnd.choice(train)[1])
        for _ in range(rnd.randint(0, 7)):
            k = rnd.randint(0, len(base))
            base[k : k + rnd.randint(0, 1)] = [rnd.choice(vocab)] if rnd.random() < 0.7 else []
        val.append((1000 + j, [t.upper() if t and rnd.random() < 0.3 else t for t in base]))
    train += [(900, None), (901, []), (902, ["..."]), (903, train[0][1]), (904, ["solo"]), (905, ["x"] * 700 + [f"k{i}" for i in range(500)])]
    val += [(1900, None), (1901, []), (1902, ["!"]), (1903, ["SOLO"]), (1904, [f"k{i}" for i in range(60)] + ["x"] * 640 + [f"k{i}" for i in range(40, 480)])]
    kind = "rec_id bigint, tokens array<string>, id string"
    t, v = (spark.createDataFrame([(*r, "clash") for r in rows], kind) for rows in (train, val))
    got = [tuple(r) for r in leakage.overlaps(t, v, "rec_id", "rec_id").collect()]
    want = brute(train, val)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert leakage.overlaps(t.limit(0), v, "rec_id", "rec_id").count() == 0


def test_overlaps_of_the_tables(spark, data):
    read = lambda n: [(r["rec_id"], r["tokens"]) for r in spark.read.parquet(f"{data}/{n}.parquet").collect()]
    want = brute(read("deepmount_pii_it_train"), read("validation_real"))
    assert {tuple(r) for r in queries.p1_found(spark, data).collect()} == want
    report = queries.p1_report(spark, data).collect()
    assert sum(r["pairs"] for r in report) == len(want) and sum(r["records"] for r in report) == len(read("validation_real"))


def test_overlaps_send_no_large_side_to_the_driver(spark, tmp_path):
    rnd = random.Random(4)
    train = [(i, [rnd.choice("abcdefghij") * 3 + str(rnd.randint(0, 400)) for _ in range(60)]) for i in range(300)]
    val = [(1000 + i, w[:-1] + ["fine"]) for i, w in train[:100]]
    read = []
    for name, rows in (("t", train), ("v", val)):
        spark.createDataFrame(rows, "rec_id bigint, tokens array<string>").write.parquet(f"{tmp_path}/{name}")
        read.append(spark.read.parquet(f"{tmp_path}/{name}"))
    joins, real = [], type(read[0]).join

    def join(a, b, *args):
        joins.append(out := real(a, b, *args))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(read[0]), "join", join)
        got = {tuple(r) for r in leakage.overlaps(*read, "rec_id", "rec_id").collect()}
    assert got == {(i, 1000 + i) for i in range(100)}
    # the guessed sizes are far under the threshold of a broadcast: only the counted pairs may be sent
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in joins[:4]]
    assert all("strategy=merge" in x for x in plans)


def test_map_of_shingles(spark):
    keys = [5, -1, 1 << 62, -(1 << 63), 77 << 40, 77 << 40]
    bits, power = leakage._map_of(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    want = {(k % (1 << 64)) >> 64 - power for k in keys}
    assert set(np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")).tolist()) == want
    assert not leakage._map_of(spark.createDataFrame([], "key bigint"))[0].any()


def test_distance_and_cover():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        d = distance(a, b)
        assert all(leakage.distance_within(a, b, m) == (d <= m) or not (a and b) for m in range(9))
    costs = [np.array(np.random.default_rng(i).random((leakage.SHINGLE, n))) for i, n in enumerate((5, 9, 30))]
    for c in costs:
        for length in range(1, leakage.SHINGLE + 1):
            c[length - 1, max(0, c.shape[1] - length + 1) :] = np.inf
    for got, k in zip(leakage.cover(costs, [2, 3, 8]), (2, 3, 8), strict=True):
        spans = sorted(got)
        assert len(spans) == k and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))


# ---- 2


def test_budget_by_differences_equals_a_new_count(spark, public):
    rows = [(1, ["Il", "sig", ".", "Rossi"], "A-b", "it-IT", "civile"), (2, ["x", "##y"], "a_B.jsonl", "ITA", "Civile"), (3, None, None, "?", ""), (4, [], "n/d", "en", "penale"), (5, ["x", "##y"], "a b", "it", "civile")]
    kind = "rec_id bigint, tokens array<string>, source string, language string, subject_domain string"
    docs = lambda r: budget.documents(spark.createDataFrame(r, kind), "rec_id", "tokens", "source", "language", "subject_domain")
    counts, totals = budget.first_run(spark, docs(rows))
    later = [rows[0], (2, ["altro"], "ab", "it", "civile"), *rows[3:], (6, ["Il", "sig", ".", "Rossi"], "zz", "de", "x")]
    after = docs(later)
    more = budget.update_counts(counts, after)
    changed = budget.apply(totals, budget.deltas(docs(rows), after, more))
    fresh = budget.first_run(spark, after)[1]
    key = lambda df: sorted(map(str, (tuple(r) for r in df.select(*budget.CUBE, "documents", "tokens").collect())))
    assert key(changed) == key(fresh)
    assert more.count() == counts.count() + 1  # only "altro" is new
    assert totals.agg(F.sum("documents")).first()[0] == 5
    text = {r["id"]: r["text"] for r in docs(rows).collect()}
    assert text[1] == "Il sig. Rossi" and text[2] == "xy" and text[3] is None
    assert totals.agg(F.sum("tokens")).first()[0] == sum(len(public(t)) for t in text.values())
    assert budget.cube(totals).where("level = 7").first()["documents"] == 5
    assert budget.first_run(spark, docs(rows).limit(0))[1].count() == 0


def test_kept_state_equals_a_new_count(spark, data, tmp_path, monkeypatch):
    assert sorted(map(repr, queries.p2_updated(spark, data).collect())) == sorted(map(repr, queries.p2_token_budget(spark, data).collect()))
    rows = lambda *r: budget.documents(spark.createDataFrame(list(r), "k bigint, t array<string>, s string, l string, d string"), "k", "t", "s", "l", "d")
    one, two, odd = (1, ["ciao", "a", "tutti"], "A", "it", "x"), (2, ["ciao"], None, None, None), (3, None, "A", "it", "x")
    path, called = str(tmp_path / "state"), []
    monkeypatch.setattr(budget, "count_tokens", lambda df, *a, **k: called.append(df.count()) or tokenizer.count_tokens(df, *a, **k))
    budget.maintain(rows(one, two, odd), path)
    assert called == [3] and budget.maintain(rows(one, two, odd), path).count() == 2 and called == [3, 0]
    last = {r["source"]: (r["documents"], r["tokens"]) for r in budget.maintain(rows(one), path).collect()}  # two documents removed
    assert list(last) == ["a"] and last["a"][0] == 1 and called == [3, 0, 0]
    monkeypatch.setattr(budget, "tokenizer_key", lambda p=None: "another")
    assert budget.maintain(rows(one, two), path).count() == 2 and called[-1] == 2 and [t for _, t in budget.runs(spark, path)][-1] == "another"
    assert budget.maintain(rows(one).limit(0), path).count() == 0
    with pytest.raises(Exception, match="no count"):
        budget.deltas(spark.createDataFrame([], budget.STATE), rows(one), spark.createDataFrame([], budget.COUNTS)).collect()


# ---- 3

SENTENCES = [
    "Il signor |Bianchi paga . |§La causa n . 12 del 3 . 4 . 2020 resta . |§« Il giudice tace . » |§( Per ora . ) |§Fine".replace("signor |", "signor "),
    "chiede : |§1 ) il decreto ; |§2 ) l ' atto , art . 5 ; |§Per mero scrupolo , la parte tace . |§Poi",
    "per la società Rossi S . p . A . |§Dopo la pausa , la ditta Verdi S . r . l . , con sede a Roma . . . |§Il resto",
    "eredi : Anna Rossi ; Bruno Verdi ; C . Neri . |§La curatela alle ore 12 : 30 ; |§2 . il verbale , h . 10 . 23 . |§Sul punto",
    "scrivendo a anna . rossi @ pec . ditta . test . |§Il notaio , sesso M . |§Con riserva , all ' avv . M . Rossi ! |§In data 5",
    "il perito ha torto . |§salvo quanto detto , c . f . abc , a mezzo p . e . c . x @ pec . y . example . |§per ora",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_natural_boundaries(marked):
    tokens, want = [], []
    for part in marked.split():
        if part.startswith("|§"):
            want.append(len(tokens))
        tokens.append(part.replace("|§", "").replace("|", ""))
    assert boundaries.natural(tokens) == want


def test_pieces_cover_overlap_and_cut_at_the_strongest(spark, data):
    rows = {r["rec_id"]: r for r in spark.read.parquet(f"{data}/synthetic_pii_it_200k.parquet").collect()}
    got = collections.defaultdict(list)
    for r in queries.p3_pieces(spark, data).collect():
        got[r["rec_id"]].append(r)
    long_ = {k for k, r in rows.items() if r["tokens"] and r["bio_labels"] and len(r["tokens"]) == len(r["bio_labels"]) > 200}
    assert set(got) == long_
    for k, ps in got.items():
        ps.sort(key=lambda p: p["piece"])
        toks, labs = rows[k]["tokens"], rows[k]["bio_labels"]
        ends = set(boundaries.natural(toks))
        assert ps[0]["start"] == 0 and ps[-1]["end"] == len(toks)
        for p, q in zip(ps, [*ps[1:], None]):
            assert p["tokens"] == toks[p["start"] : p["end"]] and p["bio_labels"] == labs[p["start"] : p["end"]] and len(p["tokens"]) <= 200
            if q:
                assert q["start"] == p["end"] - 20
                reach = [e for e in ends if p["start"] + 20 < e <= p["start"] + 200]
                assert not reach or p["end"] == max(reach)


def test_range_maximum():
    rnd = random.Random(1)
    s = [rnd.randint(-2, 3) for _ in range(300)]
    index = chunks.Strongest(s)
    for _ in range(2000):
        a = rnd.randint(0, 299)
        b = rnd.randint(a, 299)
        assert index.best(a, b) == max(range(a, b + 1), key=lambda i: (s[i], i))
    with pytest.raises(ValueError):
        chunks.spans([0] * 9, 5, 5)


def test_odd_records_for_pieces(spark):
    big = ["parola"] * 450 + [None]
    rows = [(1, None, None), (2, [], []), (3, big, big[:-1]), (4, big, ["O"] * 451), (5, ["a"], ["O"])]
    df = spark.createDataFrame(rows, "rec_id bigint, tokens array<string>, bio_labels array<string>")
    long_ = chunks.long_records(df, "rec_id")
    assert chunks.boundaries(long_, "rec_id").count() == 0
    assert [(r["start"], r["end"]) for r in chunks.pieces(long_, "rec_id").orderBy("piece").collect()] == [(0, 200), (180, 380), (360, 451)]


# ---- 4


def test_groups_and_splits(spark, data):
    rows = spark.read.parquet(f"{data}/synthetic_pii_it_200k.parquet").select("rec_id", "template_id", "source").collect()
    known = {r["id"] for r in spark.read.parquet(f"{data}/legal_templates.parquet").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def name(s):
        k = re.sub(r"[^a-z0-9]", "", re.sub(r"\.jsonl[/ ]*$", "", (s or "").lower()))
        return None if k in ("", "nd", "null", "sconosciuta") else k

    for r in rows:
        for k in [("t", r["template_id"])] * (r["template_id"] in known) + [("s", name(r["source"]))] * (name(r["source"]) is not None):
            parent[find(("r", r["rec_id"]))] = find(k)
    tpl = collections.defaultdict(set)
    for r in rows:
        if r["template_id"] in known:
            tpl[find(("r", r["rec_id"]))].add(r["template_id"])
    want = {(r["rec_id"], min(tpl[find(("r", r["rec_id"]))])) for r in rows if len(tpl[find(("r", r["rec_id"]))]) > 1}
    assert {tuple(r) for r in queries.p4_found(spark, data).collect()} == want
    split = {r["rec_id"]: r["split"] for r in queries.p4_splits(spark, data).collect()}
    assert set(split) == {r["rec_id"] for r in rows}
    per = collections.defaultdict(set)
    for r in rows:
        per[find(("r", r["rec_id"]))].add(split[r["rec_id"]])
    assert all(len(s) == 1 for s in per.values())
    n = collections.Counter(split.values())
    assert abs(n["train"] - 0.8 * len(rows)) <= 3 and abs(n["test"] - 0.1 * len(rows)) <= 3


def test_flow_and_exchange():
    flow = splits.min_cost_flow(4, [(0, 1, 5, 0), (0, 2, 5, 0), (1, 3, 4, 1), (2, 3, 3, 2), (1, 2, 5, 0)], 0, 3)
    assert flow[2] + flow[3] == 7
    rnd = random.Random(9)
    bundles = [(rnd.choice([1, 2, 5, 9, 40]), tuple(rnd.randint(0, 3) for _ in range(4)), rnd.randint(1, 12)) for _ in range(60)]
    parts = list(splits.SPLITS.values())
    sent = splits.flow_of(bundles, parts)
    assert [sum(x) for x in sent] == [n for _, _, n in bundles]
    for (_, _, n), x in zip(bundles, sent):  # within one of the bundle's share
        assert all(abs(k - n * s) < 1 + 1e-9 for k, s in zip(x, parts))
    told = np.array(splits.allocate(bundles, splits.SPLITS))
    assert told.sum(1).tolist() == [n for _, _, n in bundles] and (told >= 0).all()
    size = np.array([b[0] for b in bundles])
    quota = splits.whole(int((size * told.sum(1)).sum()), parts)
    assert np.abs(size @ told - quota).max() <= 1
    for c in {int(s).bit_length() for s in size}:  # large and small components in proportion
        some = told[[int(s).bit_length() == c for s in size]].sum(0)
        assert np.abs(some - some.sum() * np.array(parts)).max() <= 2
    assert splits.allocate([], splits.SPLITS) == [] and splits.allocate([(700, (), 1)], splits.SPLITS) == [[1, 0, 0]]


def test_shares_of_sizes_and_labels(spark):
    rnd = random.Random(11)
    rows = []
    for g in range(400):
        tag = rnd.choice(["CITY", "ATTORE", "IBAN"])
        rows += [(len(rows) + i, f"g{g}", ["B-" + tag, "O", None] if i % 3 else None) for i in range(rnd.choice([1, 1, 2, 3, 8, 20]))]
    df = spark.createDataFrame(rows, "k bigint, group string, l array<string>")
    got = {r["k"]: r["split"] for r in splits.split(df, "k", "l").collect()}
    assert set(got) == {r[0] for r in rows}
    of = collections.defaultdict(set)
    for k, g, _ in rows:
        of[g].add(got[k])
    assert all(len(s) == 1 for s in of.values())
    n = collections.Counter(got.values())
    assert abs(n["train"] - 0.8 * len(rows)) <= 1 and abs(n["test"] - 0.1 * len(rows)) <= 1
    for tag in ("CITY", "ATTORE", "IBAN"):
        share = {s: sum(1 for k, _, x in rows if got[k] == s and x and x[0][2:] == tag) / n[s] for s in n}
        assert max(share.values()) - min(share.values()) < 0.02
    sizes = collections.Counter(g for _, g, _ in rows)
    for c in {1, 2, 4, 5}:
        some = [g for g in sizes if sizes[g].bit_length() == c]
        for s, part in splits.SPLITS.items():
            assert abs(sum(of[g] == {s} for g in some) - part * len(some)) <= 2


def test_labels_of_many_profiles(spark):
    rnd = random.Random(5)
    rows, tags = [], ["CITY", "ATTORE", "IBAN", "EMAIL", "DATE", "AMOUNT", "PIVA", "CF"]
    for g in range(2000):  # nearly all profiles differ, in counts and not in which tags there are
        likely = [rnd.random() for _ in tags]
        rows += [(4 * g + i, f"g{g}", ["B-" + t for t, p in zip(tags, likely) if rnd.random() < p]) for i in range(4)]
    df = spark.createDataFrame(rows, "k bigint, group string, l array<string>")
    got = {r["k"]: r["split"] for r in splits.split(df, "k", "l").collect()}
    n = collections.Counter(got.values())
    assert [n[s] for s in splits.SPLITS] == [6400, 800, 800]
    for t in tags:
        held = collections.Counter(got[k] for k, _, x in rows if "B-" + t in x)
        for s, part in splits.SPLITS.items():
            assert abs(held[s] - part * held.total()) <= 8  # of about 400


def test_splits_of_an_empty_table(spark, data):
    syn = spark.read.parquet(f"{data}/synthetic_pii_it_200k.parquet").limit(0)
    assert splits.records_in_splits(spark, syn, spark.read.parquet(f"{data}/legal_templates.parquet")).count() == 0


# ---- 5

P5_SQL = queries.SQL["p5_found"]


def test_shortages_and_sample(spark, data):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    assert {tuple(r) for r in queries.p5_found(spark, data).collect()} == set(c.execute(P5_SQL).fetchall())
    picked, report = queries._sampled(spark, data)
    picked = [tuple(r) for r in picked.collect()]
    assert len(picked) == len(set(picked))
    for r in report.collect():
        assert r["drawn"] >= min(r["min_rows"], r["available"])
        assert abs(r["drawn"] - min(r["need"], r["available"])) <= (2 if r["plan_id"] == "by_tag" else 0)
        assert r["missed"] == (r["drawn"] < r["need"]) and r["short"] == (r["available"] < r["need"])


def test_sample_of_an_empty_table(spark, data):
    t = {n: spark.read.parquet(f"{data}/{n}.parquet") for n in ("train_subset_10k", "sample_targets", "tag_taxonomy")}
    picked, report = calibration.sample(t["train_subset_10k"].limit(0), t["sample_targets"], t["tag_taxonomy"])
    assert picked.count() == 0 and report.where("short").count() == report.where("need > 0").count() == 22


def test_tilting_meets_its_moments(spark):
    rnd = np.random.default_rng(3)
    x = np.hstack([rnd.integers(0, 2, (40, 70)), np.ones((40, 1), dtype=int)])  # more categories than a word has bits
    counts = rnd.integers(50, 500, 40)
    goal = (counts * rnd.uniform(0.1, 0.4, 40)) @ x
    rows = [(0, np.flatnonzero(r[:-1]).tolist(), int(n)) for r, n in zip(x, counts)]
    cells = spark.createDataFrame(rows, "plan int, profile array<int>, n bigint").repartition(3)
    lam = calibration.tilt(cells, {0: goal}, {0: 0.2})[0]
    p = np.minimum(1, 0.2 * np.exp(x @ lam))
    assert np.allclose((counts * p) @ x, goal, atol=0.01)


def test_pivotal_moves_no_moment():
    rnd = np.random.default_rng(1)
    x = np.hstack([rnd.integers(0, 2, (60, 4)), np.ones((60, 1))]).astype(float)
    p, sums = rnd.random(60), np.zeros(60)
    for _ in range(1500):
        out = calibration.pivotal(p, x, rnd.random(60))
        assert np.allclose(out @ x, p @ x) and ((out > 0) & (out < 1)).sum() <= 5
        last = calibration.landed(p, x, rnd.random(60))
        assert set(last) <= {0.0, 1.0} and abs(last.sum() - p.sum()) < 1 and np.abs(last @ x - p @ x).max() <= 4
        sums += last
    assert np.abs(sums / 1500 - p).max() < 0.07


def test_settling_in_rounds_equals_the_goal(spark, monkeypatch):
    monkeypatch.setattr(calibration, "TASK", 20)
    rnd = random.Random(5)
    rows = [(i % 2, f"{i}", [0] if i % 3 else [1], rnd.random(), rnd.random()) for i in range(200)]
    got = {(r["plan"], r["cell"]): r["more"] for r in calibration.settle(spark.createDataFrame(rows, "plan int, cell string, profile array<int>, p double, u double"), {0: 3, 1: 3}).collect()}
    assert len(got) == 200 and set(got.values()) <= {0, 1}
    for plan in (0, 1):
        for kind in ([0], [1]):
            assert abs(sum(got[q, c] - p for q, c, k, p, _ in rows if q == plan and k == kind)) <= 2


# ---- 7


def test_subset_sums_are_best():
    rnd = random.Random(8)
    for _ in range(60):
        counts = [(length, rnd.randint(1, 3)) for length in rnd.sample(range(3, 40), 4)]
        goal = rnd.randint(0, 120)
        sums = {0}
        for length, n in counts:
            sums = {s + k * length for s in sums for k in range(n + 1)}
        take, reached = mixture.fit(counts, goal)
        assert reached == max(s for s in sums if s <= goal) == sum(length * k for length, k in take.items())
        assert all(k <= dict(counts)[length] for length, k in take.items())


def test_mixture(spark, data, public):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    name = lambda s: re.sub(r"[^a-z]", "", (s or "").lower())
    size = {r["doc_id"]: len(public(r["text"])) for r in docs}
    total = sum(size.values())
    has = collections.Counter()
    for r in docs:
        has[name(r["source"])] += size[r["doc_id"]]
    targets = spark.read.parquet(f"{data}/mix_targets.parquet").collect()
    short = {t["source"] for t in targets if t["max_repeats"] * has[name(t["source"])] < t["weight"] * total}
    assert {r["source"] for r in queries.p7_found(spark, data).collect()} == short
    used = collections.Counter()
    for r in queries.p7_mixture(spark, data).collect():
        t = next(t for t in targets if t["source"] == r["source"])
        assert 1 <= r["times"] <= t["max_repeats"] and r["size"] == size[r["id"]]
        used[r["source"]] += r["size"] * r["times"]
    for t in targets:
        budget_ = t["weight"] * total
        assert used[t["source"]] <= budget_ + 1e-6
        if t["source"] not in short:
            assert used[t["source"]] >= budget_ - max(size.values())
    shares_ = {r["source"]: r for r in queries.p7_shares(spark, data).collect()}
    assert {k: r["tokens"] for k, r in shares_.items()} == {t["source"]: used[t["source"]] for t in targets}


def test_long_documents_fill_a_mixture(spark):
    rows = [(i, "a", 100_000 + 7 * i) for i in range(100)] + [(1000, "b", sum(100_000 + 7 * i for i in range(100)))]
    sizes = spark.createDataFrame(rows, "id int, src string, size bigint")
    plan = mixture.budgets(sizes, spark.createDataFrame([("A", 0.25, 1), ("B", 0.75, 1)], "source string, weight double, max_repeats int"))
    mix = mixture.mixture(sizes, plan)
    got = {r["source"]: r for r in mixture.shares(mix, plan).collect()}
    assert got["A"]["budget"] - 100_000 < got["A"]["tokens"] <= got["A"]["budget"] and not got["A"]["short"]
    assert {r["times"] for r in mix.where("source = 'A'").collect()} == {1}
    assert mixture.fit([(190_000, 2), (9, 1)], 250_000) == ({190_000: 1, 9: 1}, 190_009)


def test_lengths_by_ranges_fit_like_collected_ones(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SUMS", 64)
    monkeypatch.setattr(mixture, "LONGEST", 32)
    monkeypatch.setattr(mixture, "RANGES", 4)
    rnd = random.Random(3)
    for scale in (60, 400, 3000):
        lengths = [rnd.randint(1, scale) for _ in range(40)]
        sizes = spark.createDataFrame([(i, "a", n) for i, n in enumerate(lengths)], "id int, src string, size bigint")
        goal = sum(lengths) * 2 // 5
        plan = spark.createDataFrame([("a", "A", 0, goal, sum(lengths))], "src string, source string, rounds int, rest bigint, has bigint")
        hist = collections.Counter(lengths)
        bulk = {size: int(n * (goal / sum(lengths))) for size, n in hist.items()}
        done = sum(size * n for size, n in bulk.items())
        _, reached = mixture.fit([(size, n - bulk[size]) for size, n in hist.items()], goal - done)
        assert sum(r["size"] for r in mixture.mixture(sizes, plan).collect()) == done + reached


# ---- 8

ENDINGS = [
    (None, "blank"), ("", "blank"), (" \t", "blank"), ("Tutto bene.", "whole"), ("La parte ha depos", "bare"), ("come da art.", "short"), ("per la ditta Rossi S.p.A.", "whole"),
    ("giudizio.\nPag. 2 di 2", "whole"), ("ha deposi\n<!-- fine campo -->", "bare"), ("ha deposi… Leggi tutto", "bare"), ("a Roma.\nTanto si doveva…", "open"), ("fine.\nCordiali saluti\nAnna Bianchi", "signature"),
    ("fine. Allegati:\n1) copia del verbale\n2) procura", "list"), ("per la somma di € 781.", "torn"), ("per la somma di € 781,20.", "whole"), ("scrivendo a anna.rossi@pec.", "torn"),
    ("scrivendo a anna.rossi@pec.ditta.test.", "whole"), ("sesso M.", "whole"), ("per conto di M.", "short"), ("è già&agra", "torn"), ("fine.)", "whole"), ("dall'avv. Rossi…", "open"), ("così previsto (continua)", "bare"),
    ("previsto fare\\u00", "torn"), ("in gar<span cl", "torn"), ("fas\ufffd", "torn"), ("Con i migliori auguri, Anna Verdi", "signature"), ("With best wishes, John Brown", "signature"), ("Hochachtungsvoll / Max Muster", "signature"),
    ("Cordialement, Jean Dupont", "signature"), ("Un saludo, Juan Pérez", "signature"), ("Firmato: Mario Rossi", "signature"), ("Allegati: 1) contratto 2) fattura", "list"), ("Ha letto. Documenti:\n- uno\n- due\n- tre", "list"),
    ("Pagina 3 di 7", "page"), ("fine.\nRoma, 3 maggio 2019", "date"), ("il verbale\ndel 24/09/2014", "loose"), ("x" * 100_000, "bare"),
]


@pytest.mark.parametrize("text,want", ENDINGS)
def test_endings(text, want):
    assert truncation.ending(text) == want


def test_marks_and_forms():
    assert truncation.stripped("ha depo [...]\n-- dal portale --\n<p>") == ("ha depo", True) and truncation.stripped(" x ") == (" x", False)
    assert truncation.form(truncation.tokens("Letto a Roma Nord il 3 maggio 2019,\nil notaio Anna Verdi", 0)) == "letto a A il 0 , \n il notaio A".split(" ")
    assert truncation.state("Fine. ") == (True, None) and truncation.state("") == (True, None) and truncation.state("del verbale…") == (False, "verbale") and truncation.state("del ver") == (False, None)
    m = truncation.measures("a\n<è\"😀")
    assert (m["chars"], m["utf8"], m["utf16"], m["markup"], m["markup_quotes"], m["json"], m["crlf"]) == (6, 10, 7, 9, 14, 8, 7)


def told_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("ending", F.lit("clash")).withColumn("cut", F.lit("clash"))
    ends = truncation.read_endings(docs, "doc_id", "text", "source").cache()
    found = truncation.limits(ends).cache()
    full = truncation.filling(ends, found)
    told = truncation.truncated(ends, full, truncation.line_forms(ends.join(full, "id", "left_anti")), truncation.word_uses(docs, "text", ends))
    return told.cache(), found


def test_limits_are_those_of_all_texts(spark):
    fill = lambda n, i, end: (f"{i} il perito ha visto la casa e " + "vedere " * 700)[: n - len(end)] + end
    rnd = random.Random(3)
    rows = [(i, fill(500, i, "x"), "A_b") for i in range(40)] + [(100 + i, fill(4000, i, "x"), "a-B") for i in range(60)] + [(220 + i, fill(700, i, "x"), None) for i in range(9)]
    rows += [(300 + i, fill(rnd.randint(300, 4200), i, " casa."), "ab") for i in range(200)]  # whole texts of any length
    rows += [(600 + i, fill(900, i, f" casa {i:02d}."), "c") for i in range(30)]  # a limit may be filled by whole texts, too
    rows += [(700, fill(900, 1, " casa…"), "c"), (701, fill(905, 1, " casa…"), "c"), (702, fill(900, 2, " casa…"), None), (703, fill(1000, 2, " casa…"), "ab"), (704, None, "c"), (705, " ", None)]
    rows += [(800 + i, "Il perito ha visto la casa. Poi ha detto della casa. Fine.", "d") for i in range(30)]  # one text, posted again
    told, found = told_of(spark, rows)
    assert {(r["src"], r["size"]) for r in found.where("measure = 'chars' and band = 0").collect()} == {("ab", 500), ("ab", 4000), ("c", 900), (None, 700)}
    got = {r["id"]: r["cut"] for r in told.collect()}
    assert len(got) == len(rows) and {i for i, c in got.items() if c} == {i for i in got if i < 300 or i in (700, 702)}
    rep = {r["source"]: r for r in truncation.report(told).collect()}
    assert rep["a_b"]["at_limit"] + 0 == 100 if "a_b" in rep else rep["ab"]["at_limit"] == 100
    assert rep[None]["cut_texts"] == 10 and rep["c"]["share"] == 1 / 33


def test_limits_between_words(spark):
    rnd = random.Random(4)
    words = ["casa", "notaio", "verbale", "di", "perizia", "giudice"]

    def upto(n, i):
        t = f"{i}"
        while True:
            w = rnd.choice(words)
            if len(t) + 1 + len(w) > n:
                return t
            t += " " + w

    rows = [(i, upto(800, i), "a") for i in range(60)] + [(100 + i, upto(rnd.randint(200, 1500), i) + ".", "a") for i in range(150)]
    told, found = told_of(spark, rows)
    got = found.where("measure = 'chars'").collect()
    assert [(r["band"]) for r in got] == [10] and 796 <= got[0]["size"] <= 804
    assert {r["id"] for r in told.where("cut and full").collect()} == set(range(60))


def test_closings_and_marks_are_learned(spark):
    body = ["La parte numero %d ha pagato tutto", "Il perito numero %d ha visto la casa", "La casa numero %d è del notaio"]
    rows, want = [], {}

    def add(text, cut):
        want[len(rows)] = cut
        rows.append((len(rows), text, "a"))

    rnd = random.Random(6)
    for i in range(30):
        b = "Si premette che " + "il notaio vede la casa e " * rnd.randint(0, 60) + body[i % 3].lower() % i
        add(f"{b}.\nvisto e approvato da tutti", False)  # a closing without a mark, always after a whole text
        add(f"{b}.\nfine invio {i}", False)
        add(f"{b[:-4]}\nfine invio {i}", True)  # a mark after anything
        add(f"{b}. Il notaio ha{' letto' * (i % 2)}", True)
        b = b[:-3] + "e " * rnd.randint(1, 9) + b[-3:]
        for n in range(9):
            add(f"{b}. Poi {'ancora ' * rnd.randint(0, 60)}nulla. Il notaio ha letto e firmato l'atto {n}. La parte ha detto di sì.", False)
    add("La parte ha pagato. visto e approvato", True)  # part of a closing
    told, _ = told_of(spark, rows)
    assert {r["id"]: r["cut"] for r in told.collect()} == want


def test_words_end_sentences_by_their_rate(spark):
    rnd = random.Random(2)
    whole = ["La casa alta piace. Il perito ha visto la casa. Poi la parte ha pagato. Il notaio Rossi ha letto. Ha scritto Bianchi. Fine."]
    rare = ["La parte ha chiesto di vedere il verbale che sta nel fascicolo (rif. 12) e di vedere il registro rif. 3 che era da vedere e da leggere oggi. Poi nulla."]
    asked = ["È andato a casa…", "Ha detto di vedere…", "Ha scritto Bianchi…", "Ha scritto Bian…", "È CASA…", "Pari a € 781…", "Pari a € 781,20…", "Ha visto (con Bianchi…", "Ha visto (con Bianchi)…", "Ha pagato, rif."]
    for copies in (1, 30):  # a larger corpus, and texts posted again
        texts = [f"{t} Nota {i}." for i, t in enumerate((whole + rare * 20) * copies)]
        texts += ["Era da vedere. Poi basta. Era tutto.", "Era da vedere. Poi basta. Era tutto."] * copies
        rows = [(1000 + i, t + " Poi leggere." * rnd.randint(1, 90), "a") for i, t in enumerate(texts)] + [(i, t, f"b{i}") for i, t in enumerate(asked)]
        got = {r["id"]: r["cut"] for r in told_of(spark, rows)[0].where("id < 1000").collect()}
        assert [got[i] for i in range(len(asked))] == [False, True, False, True, False, True, False, True, False, True]


def test_no_texts(spark):
    told, found = told_of(spark, [(1, None, None)])
    assert found.count() == 0 and [r["cut"] for r in told.collect()] == [False] and told.where("id < 0").count() == 0
    assert truncation.report(told.limit(0)).count() == 0
