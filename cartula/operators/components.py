"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartula.plans.lineage import cut


#: Edges that one task solves alone; more are contracted on the whole cluster.
FEW = 200_000


def components(edges: DataFrame, a: str, b: str, few: int = FEW) -> DataFrame:
    """(``node``, ``component``): each node that has an edge with the smallest node of its component.

    At most ``few`` different edges (counted first) are solved by one task in memory. Of more, large-star and small-star
    steps alternate until the edges stop changing; the number of steps grows with the logarithm of the component size. Each
    step only groups by node: every node keeps a minimum and passes it on, so no neighbourhood is gathered in one
    task. Lineage is cut in the shared checkpoint folder. Null ends are ignored, self loops keep their node, no edges
    give no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    cur = cut(both.distinct())
    if cur.limit(few + 1).count() <= few:
        kind = cur.schema["u"].dataType.simpleString()
        return cut(cur.repartition(1).mapInPandas(_solve, f"node {kind}, component {kind}"))
    loops = cur.select(F.col("u").alias("node")).union(cur.select("v")).distinct()
    cur = cur.where("u <> v")
    seen = None
    while True:
        cur = _large(cur)
        cur = cut(_small(cur))
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    labels = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))
    return loops.join(labels, "node", "left").select("node", F.coalesce("to", "node").alias("component"))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union by the smaller root, paths halved."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"], batch["v"], strict=True):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    yield pd.DataFrame({"node": list(up), "component": [root(x) for x in list(up)]})


def _large(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    sym = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
