"""Samples whose shares of categories are those of a plan.

Rows are reduced to cells: the categories of the plan that a row belongs to, and how many rows do so alike. Newton's method
on the dual of exponential tilting gives each cell the probability that is nearest to a plain sample's and meets the plan's
moments; moments and their derivatives are summed on the cluster, one pass over the cells of all plans a step. Of each
cell the whole part of its expected rows is drawn; the rests are settled by the pivotal method, in which as many cells
fight as there are moments and one more, so that no moment moves. Floors are topped up, and what could not be met is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.functions.names import language_key, name_key
from cartula.llm.chunks import usable
from cartula.operators.ranking import pick_per_group
from cartula.plans.lineage import broadcast_within, cut

#: Newton steps at most, step sizes tried at once, and the rows by which a moment may miss.
STEPS, TRIES, NEAR = 60, (1.0, 0.5, 0.2, 0.05), 1e-3

#: Cells whose rests one task settles at most before the next round.
TASK = 20_000


def members(rows: DataFrame, taxonomy: DataFrame, fields: list[str]) -> DataFrame:
    """(``id``, ``field_name``, ``category``): each category that a usable row belongs to, once.

    Sources and languages under one spelling; of labels, every coarse tag that the taxonomy leads to.
    """
    parts = []
    if "source" in fields:
        parts.append(rows.select("id", F.lit("source").alias("field_name"), name_key(F.col("source")).alias("category")))
    if "language" in fields:
        parts.append(rows.select("id", F.lit("language").alias("field_name"), language_key(F.col("language")).alias("category")))
    if "bio_labels" in fields:
        raw = F.upper(F.regexp_extract(F.col("label"), r"^\s*[BbIi]-(.+?)\s*$", 1))
        tags = rows.select("id", F.explode(F.array_distinct("bio_labels")).alias("label")).select("id", raw.alias("raw")).where("raw <> ''").distinct()
        coarse = taxonomy.select(F.upper(F.trim("raw_tag")).alias("raw"), F.upper(F.trim("coarse_tag")).alias("category")).distinct()
        parts.append(tags.join(broadcast_within(coarse), "raw").select("id", F.lit("bio_labels").alias("field_name"), "category").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("category is not null")


def category_key(field: Column, category: Column) -> Column:
    """A plan's category under the spelling that members have."""
    return F.when(field == "source", name_key(category)).when(field == "language", language_key(category)).otherwise(F.upper(F.trim(category)))


def needs(targets: DataFrame, belongs: DataFrame, n_usable: int) -> DataFrame:
    """Each target with ``key``, ``need`` and ``available``: rows wanted (rounded, ties to even, no fewer than
    min_rows) and usable rows there are."""
    has = belongs.groupBy("field_name", F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("available"))
    want = F.bround(F.col("sample_fraction") * F.lit(n_usable) * F.col("target_share")).cast("bigint")
    t = targets.withColumn("key", category_key(F.col("field_name"), F.col("category"))).withColumn("need", F.greatest(want, F.col("min_rows").cast("bigint")))
    return t.join(has, ["field_name", "key"], "left").withColumn("available", F.coalesce("available", F.lit(0)))


def _sums(cells: DataFrame, lams: dict[int, list[np.ndarray]], base: dict[int, float]) -> dict[tuple[int, int], np.ndarray]:
    """For each plan and each trial of its multipliers the moments and their derivatives, summed on the cluster: what comes
    back has one number for each plan, trial and pair of categories, however many cells there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for plan, some in b[b["plan"].isin(list(lams))].groupby("plan"):
                x, n = _matrix(some["profile"], len(lams[plan][0])), some["n"].to_numpy(dtype=float)
                for t, lam in enumerate(lams[plan]):
                    p = np.minimum(1.0, base[plan] * np.exp(np.clip(x @ lam, -40, 40)))
                    h = (x * (n * np.where(p < 1, p, 0))[:, None]).T @ x
                    got = np.concatenate([(n * p) @ x, h.ravel()])
                    total[plan, t] = total.get((plan, t), 0) + got
        rows = [(plan, t, i, v) for (plan, t), got in total.items() for i, v in enumerate(got)]
        yield pd.DataFrame(rows, columns=["plan", "t", "i", "v"])

    told = cells.select("plan", "profile", "n").mapInPandas(run, "plan int, t int, i int, v double").groupBy("plan", "t", "i").agg(F.sum("v").alias("v"))
    out = {(plan, t): np.zeros(len(lam) * (len(lam) + 1)) for plan, some in lams.items() for t, lam in enumerate(some)}
    for plan, t, i, v in told.collect():
        out[plan, t][i] = v
    return out


def _matrix(profiles: Iterable, d: int) -> np.ndarray:
    """A row of 0 and 1 for each profile; the last moment, the size of the sample, counts all."""
    x = np.zeros((len(profiles), d))
    x[:, -1] = 1
    for i, p in enumerate(profiles):
        x[i, np.asarray(p, dtype=int)] = 1
    return x


def tilt(cells: DataFrame, goals: dict[int, np.ndarray], base: dict[int, float]) -> dict[int, np.ndarray]:
    """The multipliers of each plan, under which the probability of a cell, base * exp(sum of those of its categories) and
    at most 1, meets the plan's moments ``goals`` (the last: the size of the sample).

    Damped Newton steps on the dual, all plans in one pass a step; cells at 1 leave the system and take part again when they
    fall below. Moments that can't be met together are met as nearly as the steps get.
    """
    lams = {p: [np.zeros(len(g))] for p, g in goals.items()}
    best = {p: (np.inf, lams[p][0]) for p in goals}
    for _ in range(STEPS):
        if not lams:
            break
        got, after = _sums(cells, lams, base), {}
        for plan, tried in lams.items():
            d = len(goals[plan])
            t = min(range(len(tried)), key=lambda t: np.abs(got[plan, t][:d] - goals[plan]).sum())
            gap = got[plan, t][:d] - goals[plan]
            if np.abs(gap).sum() >= best[plan][0] * (1 - 1e-6):
                continue
            best[plan] = (np.abs(gap).sum(), tried[t])
            if np.abs(gap).max() > NEAR:
                h = got[plan, t][d:].reshape(d, d) + 1e-9 * np.eye(d)
                step = np.clip(np.linalg.lstsq(h, gap, rcond=None)[0], -4, 4)
                after[plan] = [tried[t] - s * step for s in TRIES]
        lams = after
    return {p: lam for p, (_, lam) in best.items()}


def pivotal(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Chances after fights: each open unit but a few ends at 0 or 1 and no moment, a column of ``x``, moves.

    As many units fight as there are independent moments and one more; where rows have one category this is a fight of two. The
    move along the one direction that keeps all moments ends with a unit at 0 or 1, whose place the next unit takes. ``u``: a uniform number each.
    """
    out, queue = p.copy(), [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    out[(p <= 1e-9)], out[(p >= 1 - 1e-9)] = 0.0, 1.0
    ring: list[int] = []
    at, draw = 0, np.random.default_rng(np.ascontiguousarray(u, dtype=float).view(np.uint64)[:64].tolist())  # the same for the same units
    while True:
        while len(ring) <= x.shape[1] and at < len(queue):
            ring.append(queue[at])
            at += 1
        if not ring:
            return out
        _, s, v = np.linalg.svd(x[ring].T)
        rank = int((s > 1e-9).sum())
        if rank >= len(ring):
            return out
        way, now = v[-1], out[ring]
        with np.errstate(divide="ignore"):
            up = np.min(np.where(way > 1e-12, (1 - now) / way, np.where(way < -1e-12, -now / way, np.inf)))
            down = np.min(np.where(way > 1e-12, now / way, np.where(way < -1e-12, (now - 1) / way, np.inf)))
        now = now + way * (up if draw.random() * (up + down) < down else -down)
        out[ring] = np.where(now < 1e-9, 0.0, np.where(now > 1 - 1e-9, 1.0, now))
        ring = [i for i in ring if 0 < out[i] < 1]


def landed(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """What fights leave open is settled with ever fewer moments, the size of the sample last, and one last number."""
    for d in range(x.shape[1] + 1):
        p = pivotal(p, x[:, d:], np.modf(u * (d + 1) * 1009)[0])
    return np.where(p >= 1, 1.0, np.where(p <= 0, 0.0, np.where(u < p, 1.0, 0.0)))


def settle(rests: DataFrame, width: dict[int, int]) -> DataFrame:
    """(``plan``, ``cell``, ``more``): 1 where a cell's rest is drawn, else 0; ``rests``: plan, cell, profile, p, u.

    Cells of like profiles stand together and fight in their task; what each task leaves open, at most a cell a moment, goes to the
    next round in fewer tasks, and the last one settles all.
    """

    def run(last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def fight(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            some = list(batches)
            kept = pd.concat(some, ignore_index=True) if some else pd.DataFrame({"plan": []})
            for plan, some in kept.groupby("plan"):
                some = some.sort_values("cell", kind="stable")
                x, go = _matrix(some["profile"], width[plan]), landed if last else pivotal
                yield some.assign(p=go(some["p"].to_numpy(dtype=float), x, some["u"].to_numpy(dtype=float)))

        return fight

    schema, done = "plan int, cell string, profile array<int>, p double, u double", []
    left = cut(rests.select("plan", "cell", "profile", "p", "u"))
    tasks = -(-left.count() // TASK)
    while tasks > 1:
        told = cut(left.repartitionByRange(tasks, "plan", "cell").mapInPandas(run(False), schema))
        done.append(told.where("p <= 0 or p >= 1"))
        left, tasks = told.where("p > 0 and p < 1"), min(tasks - 1, -(-tasks * (1 + max(width.values())) // TASK))
    out = cut(left.repartition(1).mapInPandas(run(True), schema))
    for d in done:
        out = out.unionByName(d)
    return out.select("plan", "cell", F.col("p").cast("bigint").alias("more"))


def sample(rows: DataFrame, targets: DataFrame, taxonomy: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan of ``targets``.

    ``rows``: rec_id, tokens, bio_labels, language, source. The sample is (``plan_id``, ``rec_id``); the report is
    (``plan_id``, ``category``, ``field_name``, ``target_share``, ``min_rows``, ``need``, ``available``, ``drawn``, ``share``,
    ``short``, ``missed``): ``short`` where fewer usable rows exist than needed, ``missed`` where fewer were drawn, for whatever
    reason. Unusable rows never count; duplicates count each; a category under no name is never drawn for; where each row
    has one category, rows of other categories are not drawn. An empty table gives an empty sample and a report
    in which every need above 0 is short. The driver sees the targets and sums by category, no cells.
    """
    spark = rows.sparkSession
    fields = [r[0] for r in targets.select("field_name").distinct().collect()]
    good = cut(rows.where(usable()).select(F.col("rec_id").alias("id"), "bio_labels", "language", "source"))
    n_usable = good.count()
    belongs = cut(members(good, taxonomy, fields))
    wanted = needs(targets, belongs, n_usable).select("plan_id", "field_name", "sample_fraction", "category", "key", "target_share", "min_rows", "need", "available").orderBy("plan_id", "category").collect()
    names = sorted({r["plan_id"] for r in wanted})
    of = {p: [r for r in wanted if r["plan_id"] == names[p]] for p in range(len(names))}
    goals, base, width = {}, {}, {}
    for p, t in of.items():
        goal = np.array([min(r["need"], r["available"]) for r in t], dtype=float)
        many = t[0]["field_name"] == "bio_labels"
        size = max(round(t[0]["sample_fraction"] * n_usable), goal.max(initial=0)) if many else goal.sum()
        goals[p], base[p], width[p] = np.append(goal, min(size, n_usable)), max(t[0]["sample_fraction"], 1e-6), len(t) + 1

    lines = [(p, i, r["plan_id"], r["field_name"], r["category"], r["key"], r["target_share"], r["min_rows"], r["need"], r["available"]) for p, t in of.items() for i, r in enumerate(t)]
    plan = spark.createDataFrame(lines, "plan int, i int, plan_id string, field_name string, category string, key string, target_share double, min_rows int, need bigint, available bigint")
    keys = broadcast_within(plan.select("plan", "i", "field_name", F.col("key").alias("category")))
    own = belongs.join(keys, ["field_name", "category"]).select("plan", "id", "i")
    tagged = spark.createDataFrame([(p,) for p, t in of.items() if t[0]["field_name"] == "bio_labels"], "plan int")
    others = good.select("id").crossJoin(broadcast_within(tagged)).select("plan", "id", F.lit(None).cast("int").alias("i"))
    profiled = own.unionByName(others).groupBy("plan", "id").agg(F.array_sort(F.collect_set("i")).alias("profile"))  # categories of a row
    each = cut(profiled.withColumn("cell", F.array_join(F.col("profile").cast("array<string>"), ",")))
    cells = cut(each.groupBy("plan", "cell", "profile").agg(F.count(F.lit(1)).alias("n")))

    lams = tilt(cells, goals, base)
    table = spark.createDataFrame([(p, base[p], [float(v) for v in lam]) for p, lam in lams.items()], "plan int, base double, lam array<double>")
    power = F.aggregate("profile", F.element_at("lam", -1), lambda a, i: a + F.get("lam", i))
    chance = F.least(F.lit(1.0), F.col("base") * F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), power))))
    hoped = cells.join(broadcast_within(table), "plan").withColumn("e", F.col("n") * chance).withColumn("whole", F.floor(F.col("e") + 1e-6))
    hoped = cut(hoped.withColumn("p", F.greatest(F.lit(0.0), F.col("e") - F.col("whole"))))
    rests = hoped.where("p > 1e-6").withColumn("u", F.xxhash64("plan", "cell", F.lit(seed)) / F.lit(2.0**64) + 0.5)
    quota = cut(hoped.select("plan", "cell", "whole").join(settle(rests, width), ["plan", "cell"], "left").select("plan", "cell", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("k")))
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")]
    hit = cut(pick_per_group(each, quota.where("k > 0"), ["plan", "cell"], "k", order))

    def drawn(hit: DataFrame) -> dict[tuple[int, int], int]:
        return {(r[0], r[1]): r[2] for r in hit.groupBy("plan", "profile").agg(F.count(F.lit(1)).alias("n")).select("plan", F.explode("profile").alias("i"), "n").groupBy("plan", "i").agg(F.sum("n")).collect()}

    got = drawn(hit)
    for p, t in of.items():  # floors: a category under its min_rows gets the first of its rows not drawn
        for i, r in enumerate(t):
            lack = min(r["min_rows"], r["available"]) - got.get((p, i), 0)
            if lack > 0:
                rest = each.where((F.col("plan") == p) & F.array_contains("profile", i)).join(hit.where(F.col("plan") == p).select("id"), "id", "left_anti")
                hit = cut(hit.unionByName(pick_per_group(rest, spark.createDataFrame([(p, lack)], "plan int, k int"), ["plan"], "k", order).select(*hit.columns)))
                got = drawn(hit)
    counts = spark.createDataFrame([(p, i, n) for (p, i), n in got.items()], "plan int, i int, drawn bigint")
    sizes = hit.groupBy("plan").agg(F.count(F.lit(1)).alias("size"))
    report = plan.join(counts, ["plan", "i"], "left").join(sizes, "plan", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    share = F.when(F.col("size") > 0, F.col("drawn") / F.col("size")).otherwise(0.0)
    flags = [(F.col("available") < F.col("need")).alias("short"), (F.col("drawn") < F.col("need")).alias("missed")]
    picked = hit.join(broadcast_within(plan.select("plan", "plan_id").distinct()), "plan").select("plan_id", F.col("id").alias("rec_id"))
    return picked, report.select("plan_id", "category", "field_name", "target_share", "min_rows", "need", "available", "drawn", share.alias("share"), *flags)
