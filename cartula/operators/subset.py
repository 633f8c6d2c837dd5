"""Stratified subsets with floors for rare tags; recasing of tokens for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.functions.text import capitalised, uniform
from cartula.operators.ranking import pick_per_group
from cartula.plans.lineage import broadcast_within, cut

# Tags whose tokens are recased as names, and shares of the ways of recasing, added up.
NAME_TAGS = ["FULLNAME", "STREET", "CITY", "PROVINCE", "ORG"]
RECASE = [0.35, 0.45, 0.53, 0.75]
# Rows that a subset must hold of rare tags.
RARE_FLOORS = {"AGE": 250, "CREDITCARDNUMBER": 200, "GENDER": 250, "TARGA": 200}
FLOOR = 40


def shuffled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order given by hash and seed, the same on every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def _greedy(rows: list[tuple], rank: dict[str, list], needs: dict[str, int], order: list[str], n: int) -> list:
    """Keys picked tag by tag: each tag until its need is met by what is picked already and its first other rows."""
    tags = dict(rows)
    picked: dict = {}
    for tag in order:
        have = sum(tag in t for t in picked.values())
        for key in rank.get(tag, []):
            if have >= needs[tag] or len(picked) >= n:
                break
            if key not in picked:
                picked[key] = tags[key]
                have += 1
    return list(picked)


def select(index: DataFrame, key: str, tags: str, strata: list[str], n: int, floors: dict[str, int] | None = None, floor: int = FLOOR, seed: int = 1234) -> DataFrame:
    """(``key``): a subset of at most ``n`` rows: floors of the rarest tags first, then strata by quota, then any.

    ``index``: one light row a record with an array of its tags. Rows picked for one tag count for all they hold, so
    no tag needs more than its first rows in seeded order, as many as all floors together: these alone come to the
    driver (tags x sum of floors, both parameters), with the counts of tags and strata. Strata, the largest first,
    are filled to their quotas (rounded, ties to even) and the rest at random, on the cluster. An empty index gives
    no rows; rows without tags can come in by their stratum.
    """
    floors = RARE_FLOORS if floors is None else floors
    spark = index.sparkSession
    names = [f"s{i}" for i in range(len(strata))]
    idx = cut(index.select(F.col(key).alias("id"), F.array_distinct(tags).alias("tags"), *[F.col(c).alias(s) for c, s in zip(strata, names, strict=True)]))
    total = idx.count()
    n = min(n, total)
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")]
    kind = index.schema[key].dataType.simpleString()

    one = idx.select("id", "tags", F.explode("tags").alias("tag"))
    seen = [r["tag"] for r in one.groupBy("tag").agg(F.count(F.lit(1)).alias("rows")).orderBy("rows", "tag").collect()]
    needs = {t: floors.get(t, floor) for t in seen}
    first = pick_per_group(one, one.select("tag").distinct().withColumn("k", F.lit(sum(needs.values()))), ["tag"], "k", order)
    rows = first.select("tag", "id", "tags", order[0].alias("h")).orderBy("h", "id").collect()
    rank: dict[str, list] = {}
    for r in rows:
        rank.setdefault(r["tag"], []).append(r["id"])
    picked = _greedy([(r["id"], r["tags"]) for r in rows], rank, needs, seen, n)
    got = cut(spark.createDataFrame([(k,) for k in picked], f"id {kind}"))
    have = len(picked)

    marked = cut(idx.select("id", *names).join(broadcast_within(got.withColumn("in", F.lit(True))), "id", "left"))
    counts = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"), F.count("in").alias("have")).orderBy(F.desc("rows"), *names).collect()
    quota = []
    for r in counts:
        k = min(max(0, round(n * r["rows"] / total) - r["have"]), n - have)
        have += k
        quota.append((*[r[c] for c in names], k))
    fields = [f"{c} {marked.schema[c].dataType.simpleString()}" for c in names]
    rest = marked.where("in is null").drop("in")
    fill = pick_per_group(rest, spark.createDataFrame(quota, ", ".join([*fields, "k int"])), names, "k", order).select("id")
    got = cut(got.union(fill))
    if have < n:
        left = idx.join(got, "id", "left_anti").select("id", F.lit(1).alias("one"))
        got = got.union(pick_per_group(left, spark.createDataFrame([(1, n - have)], "one int, k int"), ["one"], "k", order).select("id"))
    return got.withColumnRenamed("id", key)


def fetch(rows: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """The full rows of a subset."""
    return rows.join(picked, key, "left_semi")


def recase(df: DataFrame, key: str, tokens: str, labels: str, seed: int = 42) -> DataFrame:
    """``df`` with recased tokens: by row 35 % small, 10 % capitals, 8 % token by token, 22 % names only, else as they are."""
    u, v = uniform(F.col(key), seed=seed), uniform(F.col(key), F.lit("how"), seed=seed)
    toks = F.col(tokens)
    each_ = F.transform(toks, lambda t, i: F.when(uniform(F.col(key), i, seed=seed) < 0.5, F.upper(t)).otherwise(F.lower(t)))
    how: Column = v  # a third each

    def name(x: Column) -> Column:
        t = x["t"]
        new = F.when(how < 1 / 3, F.lower(t)).when(how < 2 / 3, F.upper(t)).otherwise(capitalised(t))
        return F.when((x["l"] != "O") & F.substring(x["l"], 3, 1000).isin(NAME_TAGS), new).otherwise(t)

    names = F.transform(F.arrays_zip(toks.alias("t"), F.col(labels).alias("l")), name)
    new = F.when(u < RECASE[0], F.transform(toks, lambda t: F.lower(t))).when(u < RECASE[1], F.transform(toks, lambda t: F.upper(t))).when(u < RECASE[2], each_).when(u < RECASE[3], names).otherwise(toks)
    return df.withColumn(tokens, new)
