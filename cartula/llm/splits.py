"""Splits that keep related records together.

Records that share a template or a source, directly or through others, form a component. Components that hold more than
a fixed part of all records are heavy, so there is a fixed number of them at most; those of one size and label profile form
a bundle. A min-cost flow sends the components of every bundle through classes of like size to the splits: each split's share of
a bundle and of a class is free, what goes beyond costs more by the records that it moves. All other components, by their exact
label counts, go one by one to the split that lacks most of what they hold, on the cluster in blocks by hash. An exchange of
single components, heavy ones and small ones alike, then brings the splits to their quotas of records and of labels.
The same steps run on any input; a hash decides between like components.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartula.functions.names import name_key
from cartula.operators.components import components
from cartula.operators.ranking import hashed_rank
from cartula.operators.taxonomy import coarse
from cartula.plans.lineage import broadcast_within, cut, lookup

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}

#: Cost of a record beyond the share that a split has of its bundle, and of its class of size.
BUNDLE_COST, CLASS_COST = 1, 4

#: Cost in the exchange of a record beyond a split's quota, of a component beyond its share of a class, in records, and of a label.
QUOTA_WEIGHT, CLASS_WEIGHT, LABEL_WEIGHT = 20.0, 4.0, 1.0

#: A component is heavy when so many of its size would hold more than all records: there are fewer heavy ones than that.
MOST_HEAVY = 1_500

#: Components of a block, about, that are dealt out by one task; sizes up to which single components of blocks may change splits later.
BLOCK, SMALL = 10_000, 64

#: Tags whose counts make up a profile: the most frequent ones; rarer ones are not balanced.
MOST_TAGS = 64

#: Components moved at random before the exchange is tried again, and how much work the tries may be (bundles looked at, about).
KICK, WORK = 8, 200_000


def grouped(records: DataFrame, templates: DataFrame, key: str, template: str, source: str, template_key: str, more: str | None = None) -> DataFrame:
    """(``key``, ``group``, ``group_template_id``, ``n_templates``) of every record, and the column ``more`` if one is named.

    Only templates that ``templates`` holds relate records; sources relate under one spelling; a null or missing
    value relates nothing, so a record without either is a group of its own. ``group`` is a string; the last two
    columns are the least template id of the group and how many there are (null and 0 where there is none).
    """
    ids = broadcast_within(templates.select(F.col(template_key).cast("int").alias("known")).where("known is not null").distinct())
    kept = [F.col(more).alias("more")] if more else []
    rows = records.select(F.col(key).alias("id"), F.col(template).cast("int").alias("tpl"), name_key(F.col(source)).alias("src"), *kept)
    rows = rows.join(ids, F.col("tpl") == F.col("known"), "left").select(F.col("known").alias("tpl"), *[c for c in rows.columns if c != "tpl"])
    pairs = cut(rows.where("tpl is not null or src is not null").groupBy("tpl", "src").agg(F.count(F.lit(1)).alias("n")))
    least = cut(pairs.where("src is not null").groupBy("src").agg(F.min("tpl").alias("least")))
    star = pairs.where("src is not null and tpl is not null").join(least, "src").select("tpl", "least").distinct()
    told = cut(components(star, "tpl", "least"))
    alone = pairs.where("tpl is not null").select("tpl").distinct().join(told, F.col("tpl") == F.col("node"), "left")
    label = cut(alone.select("tpl", F.coalesce("component", "tpl").alias("t_group")))
    sizes = label.groupBy("t_group").agg(F.count(F.lit(1)).alias("n_templates"))
    known = label.join(sizes, "t_group")
    of_source = least.join(known, F.col("least") == F.col("tpl"), "left").select("src", F.col("t_group").alias("s_group"), F.col("n_templates").alias("s_n"))
    both = lookup(lookup(rows, known, "tpl"), of_source, "src")
    found = F.coalesce("t_group", "s_group")
    return both.select(
        F.col("id").alias(key),
        F.when(found.isNotNull(), F.concat(F.lit("t"), found)).when(F.col("src").isNotNull(), F.concat(F.lit("s"), "src")).otherwise(F.concat(F.lit("r"), "id")).alias("group"),
        found.alias("group_template_id"),
        F.coalesce("n_templates", "s_n", F.lit(0)).cast("bigint").alias("n_templates"),
        *([F.col("more").alias(more)] if more else []),
    )


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximal flow of least cost; shortest paths with potentials."""
    to, room, cost, at = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for x, y, c_, w_ in ((u, v, c, w), (v, u, 0, -w)):
            at[x].append(len(to))
            to.append(y)
            room.append(c_)
            cost.append(w_)
    high = [0] * n
    while True:
        far, via = [None] * n, [-1] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in at[u]:
                if room[e] and (far[to[e]] is None or d + cost[e] + high[u] - high[to[e]] < far[to[e]]):
                    far[to[e]] = d + cost[e] + high[u] - high[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (far[to[e]], to[e]))
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        high = [h + (f if f is not None else far[sink]) for h, f in zip(high, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def whole(amount: int, shares: list[float]) -> list[int]:
    """``amount`` parted by ``shares`` in whole numbers, the largest remainders rounded up."""
    exact = [amount * s for s in shares]
    out = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: out[i] - exact[i])[: amount - sum(out)]:
        out[i] += 1
    return out


#: A bundle: size of its components, their label counts, how many components there are.
Bundle = tuple[int, tuple[float, ...], int]


def flow_of(bundles: list[Bundle], shares: list[float]) -> list[list[int]]:
    """For each bundle how many components go to each split, by the min-cost flow over bundles, size classes and splits.

    A class holds sizes of one power of two. Arcs from a bundle to its class in a split, and from there to the split, are
    free up to the share (rounded down), then cost by the part of a component that goes beyond, then by all of it, in records.
    What is free on every arc of its way is sent first; the flow decides the rest, class by class, for classes share no arc that can fill.
    """
    k = len(shares)
    told = [[int(n * s + 1e-9) for s in shares] for _, _, n in bundles]
    for c in sorted({b[0].bit_length() for b in bundles}):
        inside = [i for i, b in enumerate(bundles) if b[0].bit_length() == c]
        many = sum(bundles[i][2] for i in inside)
        mean = sum(bundles[i][0] * bundles[i][2] for i in inside) / many
        arcs, of = [], {}
        cell0, split0, sink = 1 + len(inside), 1 + len(inside) + k, 1 + len(inside) + 2 * k

        def tiers(u: int, v: int, exact: float, sent: int, most: int, cost: float) -> list[int]:
            free, at = int(exact + 1e-9) - sent, len(arcs)
            arcs.append((u, v, free, 0))
            arcs.append((u, v, 1, round(100 * cost * max(0.0, 1 - 2 * (exact % 1)))))
            arcs.append((u, v, max(0, most - free - 1), round(200 * cost)))
            return list(range(at, len(arcs)))

        for r, i in enumerate(inside):
            size, _, n = bundles[i]
            rest = n - sum(told[i])
            arcs.append((0, 1 + r, rest, 0))
            for j, s in enumerate(shares):
                of[r, j] = tiers(1 + r, cell0 + j, n * s, told[i][j], rest, BUNDLE_COST * size)
        left = sum(a[2] for a in arcs if a[0] == 0)
        for j, s in enumerate(shares):
            tiers(cell0 + j, split0 + j, many * s, sum(told[i][j] for i in inside), left, CLASS_COST * mean)
            arcs.append((split0 + j, sink, left, 0))
        flow = min_cost_flow(sink + 1, arcs, 0, sink)
        for r, i in enumerate(inside):
            for j in range(k):
                told[i][j] += sum(flow[a] for a in of[r, j])
    return told


class Exchange:
    """Single components change splits while that lowers the deviations from quotas of records, shares of the classes and of labels."""

    def __init__(self, bundles: list[Bundle], told: list[list[int]], shares: list[float], base: tuple[np.ndarray, np.ndarray] | None = None):
        """``base``: records and labels (split x tag) that the splits hold besides the bundles."""
        self.k, self.share = len(shares), np.array(shares)
        self.size = np.array([b[0] for b in bundles], dtype=float)
        self.tags = np.array([b[1] for b in bundles], dtype=float).reshape(len(bundles), -1)
        kinds, self.of = np.unique([b[0].bit_length() for b in bundles], return_inverse=True)
        self.weight = np.array([self.size[self.of == c].mean() for c in range(len(kinds))])
        many = np.array([b[2] for b in bundles], dtype=float)
        more = base or (np.zeros(self.k), np.zeros((self.k, self.tags.shape[1])))
        self.quota = np.array(whole(round((self.size * many).sum() + more[0].sum()), shares), dtype=float) - more[0]
        self.goal = np.outer(self.share, (self.tags * many[:, None]).sum(0) + more[1].sum(0)) - more[1]  # split x tag
        self.fair = np.outer(np.bincount(self.of, many), self.share)
        self.set(np.array(told, dtype=float))

    def set(self, x: np.ndarray) -> None:
        self.x = x
        self.classes = np.zeros_like(self.fair)
        np.add.at(self.classes, self.of, x)
        self.records, self.labels = self.size @ x - self.quota, (self.tags.T @ x).T - self.goal

    def total(self) -> float:
        over = np.maximum(np.abs(self.classes - self.fair) - 1, 0) * self.weight[:, None]
        return QUOTA_WEIGHT * np.abs(self.records).sum() + CLASS_WEIGHT * over.sum() + LABEL_WEIGHT * np.abs(self.labels).sum()

    def gain(self, size: np.ndarray, tags: np.ndarray, a: int, b: int, part: np.ndarray | None) -> np.ndarray:
        """Change of the total when so many records and labels go from split a to b, and one component of class ``part`` unless it is a swap."""
        r, t, d = self.records, self.labels, self.classes - self.fair
        out = QUOTA_WEIGHT * (np.abs(r[a] - size) + np.abs(r[b] + size) - abs(r[a]) - abs(r[b]))
        out = out + LABEL_WEIGHT * (np.abs(t[a] - tags) + np.abs(t[b] + tags) - np.abs(t[a]) - np.abs(t[b])).sum(-1)
        if part is not None:
            over = lambda v: np.maximum(np.abs(v) - 1, 0)
            out = out + CLASS_WEIGHT * self.weight[part] * (over(d[part, a] - 1) + over(d[part, b] + 1) - over(d[part, a]) - over(d[part, b]))
        return out

    def move(self, row: int, a: int, b: int) -> None:
        for to, n in ((a, -1), (b, 1)):
            self.x[row, to] += n
            self.classes[self.of[row], to] += n
            self.records[to] += n * self.size[row]
            self.labels[to] += n * self.tags[row]

    def step(self, swaps: int) -> bool:
        """The best move, or swap inside a class of one of the ``swaps`` largest; whether there was one."""
        best = (-1e-6, ())
        for a, b in itertools.permutations(range(self.k), 2):
            here = np.flatnonzero(self.x[:, a] > 0)
            if not len(here):
                continue
            g = self.gain(self.size[here], self.tags[here], a, b, self.of[here])
            if g.min() < best[0]:
                best = (g.min(), ((here[g.argmin()], a, b),))
            there = np.flatnonzero(self.x[:, b] > 0)
            for i in here[np.argsort(-self.size[here], kind="stable")[:swaps]] if a < b else []:
                peers = there[self.of[there] == self.of[i]]
                if len(peers):
                    g = self.gain(self.size[i] - self.size[peers], self.tags[i] - self.tags[peers], a, b, None)
                    if g.min() < best[0]:
                        best = (g.min(), ((i, a, b), (peers[g.argmin()], b, a)))
        for one in best[1]:
            self.move(*one)
        return bool(best[1])

    def run(self, steps: int, tries: int, swaps: int) -> list[list[int]]:
        """Steps until none helps; then ``tries`` times a few components are moved at random and steps taken again, the best kept."""
        rnd = np.random.default_rng(0)
        best, low = None, np.inf
        for n in range(1 + tries):
            if n:
                self.set(best.copy())
                for row in rnd.integers(0, len(self.x), KICK):
                    a, b = rnd.choice(self.k, 2, replace=False)
                    if self.x[row, a] > 0:
                        self.move(row, a, b)
            for _ in range(steps):
                if not self.step(swaps):
                    break
            if (now := self.total()) < low:
                best, low = self.x.copy(), now
        return best.astype(int).tolist()


def allocate(bundles: list[Bundle], shares: dict[str, float], cells: list[Bundle] = (), placed: list[list[int]] = (), base: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[int]]:
    """For each bundle, then for each cell, how many of its components go to each split: the flow for bundles, for cells what is ``placed``,
    then the exchange (``base``: see there); about WORK bundles are looked at."""
    every = [*bundles, *cells]
    if not every:
        return []
    parts = list(shares.values())
    tries = min(60, WORK // (30 * len(every)))
    return Exchange(every, [*flow_of(bundles, parts), *placed], parts, base).run(steps=min(400, 30 + WORK // (10 * len(every))), tries=tries, swaps=64)


def deal(sizes: np.ndarray, tags: np.ndarray, shares: list[float]) -> np.ndarray:
    """The split of each component, in the order given: where what it holds (records, records of its class of size, labels) lacks most."""
    share, m = np.array(shares), tags.shape[1]
    kinds = np.frexp(sizes.astype(float))[1]
    lack = np.zeros((len(share), 1 + m + int(kinds.max(initial=0)) + 1))
    out = np.zeros(len(sizes), dtype=np.int64)
    for i, (size, kind) in enumerate(zip(sizes, kinds, strict=True)):
        at = np.concatenate([[0], 1 + np.flatnonzero(tags[i]), [1 + m + kind]])
        x = np.concatenate([[size], tags[i][tags[i] != 0], [size]]).astype(float)
        weight = x.copy()
        weight[-1] *= CLASS_WEIGHT
        lack[:, at] += share[:, None] * x
        out[i] = j = int(np.argmax(lack[:, at] @ weight))
        lack[j, at] -= x
    return out


def _dealt(light: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``light`` (group, size, tags, draw) with ``split``, dealt out in blocks by hash."""
    names = np.array(list(shares))

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("draw", "ascending"), ("group", "ascending")])
        tags = np.array(block.column("tags").to_pylist(), dtype=np.int64).reshape(block.num_rows, -1)
        told = names[deal(block.column("size").to_numpy(), tags, list(shares.values()))]
        return block.select(["group", "size", "tags", "draw"]).append_column("split", pa.array(told.tolist(), pa.string()))

    blocks = 1 + light.count() // BLOCK
    return light.withColumn("block", F.pmod("draw", F.lit(blocks))).groupBy("block").applyInArrow(run, "group string, size bigint, tags array<bigint>, draw bigint, split string")


def _changes(before: list[int], after: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, how many) that turns one count by split into another."""
    out, now = [], list(before)
    for a, b in itertools.permutations(range(len(now)), 2):
        if (n := min(now[a] - after[a], after[b] - now[b])) > 0:
            out.append((a, b, n))
            now[a], now[b] = now[a] - n, now[b] + n
    return out


def split(groups: DataFrame, key: str, labels: str, shares: dict[str, float] = SPLITS, seed: int = 42) -> DataFrame:
    """(``key``, ``group``, ``split``) of every record of ``groups`` (see grouped, with the labels); a group is never divided.

    The profile of a group is how many of its records hold each coarse tag. Heavy groups, fewer than MOST_HEAVY, and sums of the
    others by size up to SMALL reach the driver. An empty table gives no rows; null labels hold no tag; keys must be unique; shares are met
    as far as the largest groups allow.
    """
    spark, parts = groups.sparkSession, list(shares)
    tag = lambda x: F.upper(F.regexp_extract(x, r"^[BbIi]-(.+)$", 1))
    fine = F.array_distinct(F.transform(F.array_distinct(labels), lambda x: coarse(tag(x))))
    member = cut(groups.select(F.col(key).alias("id"), "group", F.filter(fine, lambda t: t != "").alias("tags")))
    counted = member.select("group", F.explode("tags").alias("tag")).groupBy("group", "tag").agg(F.count(F.lit(1)).alias("n"))
    vector = counted.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("counts"))  # as many as tags
    sized = member.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    names = [r[0] for r in counted.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").limit(MOST_TAGS).collect()]
    told = F.array(*[F.coalesce(F.col("counts")[t], F.lit(0)) for t in names]).cast("array<bigint>")
    comps = cut(sized.join(vector, "group", "left").select("group", "size", told.alias("tags"), F.xxhash64("group", F.lit(seed)).alias("draw")))
    total = comps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy = F.col("size") * MOST_HEAVY > total
    light = cut(_dealt(comps.where(~heavy), shares))

    kinds: dict[tuple, list[str]] = {}
    for r in comps.where(heavy).orderBy("size", "tags", "draw", "group").collect():
        kinds.setdefault((r["size"], tuple(r["tags"])), []).append(r["group"])
    bundles = [(size, tags, len(of)) for (size, tags), of in kinds.items()]

    sums = [F.sum(F.col("tags")[i]).alias(f"t{i}") for i in range(len(names))]
    cell = F.when(F.col("size") <= SMALL, F.col("size")).otherwise(0).alias("cell")
    got = light.groupBy(cell, "split").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("records"), *sums).collect()
    records, held = np.zeros(len(parts)), np.zeros((len(parts), len(names)))
    placed: dict[int, list[int]] = {}
    labels_of: dict[int, np.ndarray] = {}
    for r in got:
        j, of = parts.index(r["split"]), np.array(r[4:], dtype=float)
        held[j] += of
        if r["cell"]:
            placed.setdefault(r["cell"], [0] * len(parts))[j] = r["n"]
            labels_of[r["cell"]] = labels_of.get(r["cell"], 0) + of
        else:
            records[j] += r["records"]
    sizes = sorted(placed)
    cells = [(c, tuple(labels_of[c] / sum(placed[c])), sum(placed[c])) for c in sizes]
    for c, mean, _ in cells:
        held -= np.outer(placed[c], mean)
    final = allocate(bundles, shares, cells, [placed[c] for c in sizes], (records, held))

    fixed = []
    for of, counts in zip(kinds.values(), final, strict=False):
        fixed += zip(of, [name for name, n in zip(parts, counts, strict=True) for _ in range(n)], strict=True)
    moved = []
    for c, counts in zip(sizes, final[len(bundles) :], strict=True):
        upto = dict.fromkeys(range(len(parts)), 0)
        for a, b, n in _changes(placed[c], counts):
            moved.append((c, parts[a], upto[a], upto[a] + n, parts[b]))
            upto[a] += n
    plan = spark.createDataFrame(moved, "size bigint, split string, above bigint, upto bigint, to string")
    touched = F.broadcast(plan.select("size", "split").distinct())  # at most SMALL sizes in each split
    ranked = hashed_rank(light.join(touched, ["size", "split"], "left_semi").select("group", "size", "split"), ["size", "split"], [F.xxhash64("group", F.lit(seed)), F.col("group")], "place")
    change = cut(ranked.join(F.broadcast(plan), ["size", "split"]).where("place > above and place <= upto").select("group", "to"))
    small = lookup(light.select("group", "split"), change, "group").select("group", F.coalesce("to", "split").alias("split"))
    chosen = small.unionByName(spark.createDataFrame(fixed, "group string, split string"))
    return lookup(member.select("id", "group"), chosen, "group").select(F.col("id").alias(key), "group", "split")


def related(records: DataFrame, templates: DataFrame) -> DataFrame:
    """Records of groups that hold at least two known templates, with the least of them."""
    g = grouped(records, templates, "rec_id", "template_id", "source", "id")
    return g.where("n_templates >= 2").select("rec_id", "group_template_id")


def records_in_splits(spark: SparkSession, records: DataFrame, templates: DataFrame) -> DataFrame:
    return split(grouped(records, templates, "rec_id", "template_id", "source", "id", "bio_labels"), "rec_id", "bio_labels")
