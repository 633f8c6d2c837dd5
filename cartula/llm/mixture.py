"""A mixture of sources with given weights, as large as the corpus, filled to the token.

Each source gets its weight of all tokens as its budget. Whole rounds of all its documents come first; the rest is a
bounded subset sum over the counts of documents by exact token length: a proportional part of each length, the longest
that still fit, and a dynamic program for what remains. Seeded ranks then pick that many documents of each length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.functions.names import name_key
from cartula.llm.tokenizer import count_tokens
from cartula.operators.ranking import pick_per_group
from cartula.plans.lineage import broadcast_within, cut

#: Sums that the dynamic program tells apart, and the length up to which counts are collected before any is taken.
SUMS, LONGEST = 1 << 17, 1 << 16

#: Ranges of lengths over LONGEST whose sums the driver sees at a time.
RANGES = 1024


def measured(docs: DataFrame, key: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """(``id``, ``src``, ``size``): each document's source under one spelling and its tokens."""
    rows = docs.select(F.col(key).alias("id"), name_key(F.col(source)).alias("src"), F.col(text).alias("text"))
    return cut(count_tokens(rows, "text", "size", path))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: its ``budget`` in tokens, what its source ``has``, ``rounds`` of all its documents,
    the ``rest`` to fill by single documents, and ``short``: whether the allowed repeats can't reach the budget.

    Documents of unknown source count in the total only. A source without documents is short unless its budget is 0.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total"))
    has = sizes.where("src is not null").groupBy("src").agg(F.sum("size").alias("has"))
    t = targets.select("source", "weight", "max_repeats", name_key(F.col("source")).alias("src"))
    rows = t.join(has, "src", "left").crossJoin(F.broadcast(total)).withColumn("has", F.coalesce("has", F.lit(0)))  # total: one row
    rows = rows.withColumn("budget", F.col("weight") * F.col("total")).withColumn("short", F.col("max_repeats") * F.col("has") < F.col("budget"))
    whole = F.when(F.col("has") > 0, F.floor(F.col("budget") / F.col("has"))).otherwise(0)
    rows = rows.withColumn("rounds", F.least(whole, F.col("max_repeats")).cast("int"))
    rest = F.when(F.col("rounds") < F.col("max_repeats"), F.floor(F.col("budget") - F.col("rounds") * F.col("has"))).otherwise(0)
    return rows.withColumn("rest", rest.cast("bigint"))


def fit(counts: list[tuple[int, int]], goal: int) -> tuple[dict[int, int], int]:
    """How many documents of each length fill ``goal`` from below, and the sum reached; no unused one would fit as well.

    ``counts``: (length, documents). Long ones are taken greedily until few sums are left; a bounded knapsack over
    binary parts of the counts decides the last ``SUMS`` tokens exactly. If more than those are left, only one more
    document can fit, and the longest that does is taken.
    """
    take: dict[int, int] = {}
    left, open_ = goal, {}
    for length, n in sorted(counts, reverse=True):
        if length <= 0:
            continue
        k = min(n, max(0, left - SUMS // 2) // length)
        if k:
            take[length] = k
            left -= k * length
        open_[length] = n - k
    if left > SUMS and (one := max((x for x, n in open_.items() if n and x <= left), default=0)):
        take[one] = take.get(one, 0) + 1
        open_[one] -= 1
        left -= one
    top = min(left, SUMS)
    reach = np.zeros(top + 1, dtype=bool)
    reach[0] = True
    first = np.full(top + 1, -1, dtype=np.int32)
    parts: list[tuple[int, int]] = []
    for length, n in open_.items():
        k = 1
        n = min(n, top // length)
        while n > 0 and not reach[top]:
            k = min(k, n)
            parts.append((length, k))
            step = length * k
            if step <= top:
                new = np.zeros_like(reach)
                new[step:] = reach[:-step]
                new &= ~reach
                first[new] = len(parts) - 1
                reach |= new
            n -= k
            k *= 2
    s = int(np.flatnonzero(reach)[-1])
    reached = goal - left + s
    while s:
        length, k = parts[first[s]]
        take[length] = take.get(length, 0) + k
        s -= length * k
    return take, reached


def longest_first(counts: DataFrame, most: int, goal: int) -> tuple[list[tuple[int, int]], dict[int, int], int]:
    """What ``fit`` takes greedily of the lengths over ``LONGEST``, however many they are: ranges (above, up to) of
    lengths of which all documents are taken, how many are taken of the lengths where a range breaks off, and what is
    left of ``goal``.

    ``counts``: (``size``, ``n``), ``most``: the greatest size. Each range ends where its tokens exceed the room; that
    length is found by sums over ever smaller ranges. What is left is at least halved by each, so there are few.
    """
    whole, part, left = [], {}, goal
    top = min(most, left - SUMS // 2)
    while top > LONGEST:
        room, high, low, width = left - SUMS // 2, top, LONGEST, 2
        while width > 1:
            width = -(-(high - low) // RANGES)
            place = F.floor((F.lit(high) - F.col("size")) / F.lit(width)).alias("place")
            sums = counts.where((F.col("size") > low) & (F.col("size") <= high)).groupBy(place).agg(F.sum(F.col("size") * F.col("n")).alias("tokens"))
            for i, tokens in sorted(tuple(r) for r in sums.collect()):
                if tokens > room:
                    high, low = high - i * width, max(low, high - (i + 1) * width)
                    break
                room -= tokens
            else:
                high, width = LONGEST, 1
        if high < top:
            whole.append((high, top))
        if high > LONGEST and room >= high:
            part[high] = room // high
            room %= high
        left = room + SUMS // 2
        top = min(high - 1, room)
    return whole, part, left


def mixture(sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(``id``, ``source``, ``size``, ``times``): each document of the mixture and how often it is used.

    ``plan``: see budgets. No document is used more than ``max_repeats`` times. Documents without tokens come with
    the whole rounds. What reaches the driver is one row for each target, and the counts of the documents left
    over by length, at most ``SUMS`` for each target; of longer ones sums over ranges of lengths.
    """
    spark = sizes.sparkSession
    plan = cut(plan)
    rows = sizes.join(broadcast_within(plan.select("src", "source", "rounds", "rest", "has")), "src")
    hist = rows.where("rest > 0 and size > 0").groupBy("source", "size", "rest", "has").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumn("bulk", F.floor(F.col("n") * (F.col("rest") / F.col("has"))).cast("bigint"))
    hist = cut(hist.withColumn("open", F.col("n") - F.col("bulk")))
    per = hist.groupBy("source", "rest").agg(
        F.sum(F.col("bulk") * F.col("size")).alias("sum"),
        F.max(F.when(F.col("open") > 0, F.col("size"))).alias("most"),
        F.coalesce(F.sum(F.when(F.col("size") <= LONGEST, F.col("open") * F.col("size"))), F.lit(0)).alias("short"),
    )
    more, spans = [], []
    for source, rest, done, most, short in per.collect():
        left = hist.where((F.col("source") == source) & (F.col("open") > 0)).select("size", F.col("open").alias("n"))
        whole, part, goal = longest_first(left, most or 0, rest - done)
        for above, upto in whole:
            left = left.where(~((F.col("size") > above) & (F.col("size") <= upto)))
        counts = [(r["size"], r["n"] - part.get(r["size"], 0)) for r in left.where(F.col("size") <= SUMS).collect()]
        if goal - short > SUMS:  # all short ones are taken, and at most one long one more
            one = left.where((F.col("size") > SUMS) & (F.col("size") <= goal - short)).agg(F.max("size")).first()[0]
            counts += [(one, 1)] * (one is not None)
        take, _ = fit(counts, goal)
        more += [(source, size, take.get(size, 0) + part.get(size, 0)) for size in {*take, *part}]
        spans += [(source, above, upto) for above, upto in whole]
    extra = spark.createDataFrame(more, "source string, size bigint, extra bigint")
    if spans:
        s = spark.createDataFrame(spans, "source string, above bigint, upto bigint")
        all_of = hist.where(F.col("open") > 0).join(F.broadcast(s), "source").where("size > above and size <= upto")  # few rows a target
        extra = extra.unionByName(all_of.select("source", "size", F.col("open").alias("extra")))
    quota = hist.select("source", "size", "bulk").join(broadcast_within(extra), ["source", "size"], "left")
    quota = quota.select("source", "size", (F.col("bulk") + F.coalesce("extra", F.lit(0))).alias("quota")).where("quota > 0")
    keyed = rows.where("rest > 0 and size > 0").select("id", "source", "size")
    once = pick_per_group(keyed, quota, ["source", "size"], "quota", [F.xxhash64("id", F.lit(seed)), F.col("id")])
    rounds = rows.where("rounds > 0").select("id", "source", "size", F.col("rounds").alias("times"))
    both = rounds.unionByName(once.withColumn("times", F.lit(1)))
    return both.groupBy("id", "source", "size").agg(F.sum("times").cast("int").alias("times"))


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: weight, budget, tokens reached, the share reached, documents and whether its source is too small."""
    got = mix.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_used"))
    rows = plan.select("source", "weight", "budget", "max_repeats", "short", "total").join(got, "source", "left").fillna(0, ["tokens", "documents", "most_used"])
    share = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)
    return rows.select("source", "weight", "budget", "max_repeats", "tokens", share.alias("share"), "documents", "most_used", "short")
