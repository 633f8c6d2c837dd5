"""Records of evaluation splits that also stand, exactly or nearly, in the training split.

Two records are near when at most one fifth of the words of the longer one would have to be replaced, added or
removed. The join is exact: an evaluation record with at most d such operations against any partner is covered by
d + 1 disjoint shingles of which one must stand unchanged in the partner, at most d places away. The shingles are
chosen by dynamic programming as the rarest set of disjoint ones (1 to 6 words), indexed, and probed with every
shingle of the training records; length, position and a parity signature of the words prune before the edit
distance is verified. Every filter can only let false candidates through, never lose a pair.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from cartula.functions.names import name_key, spelling
from cartula.plans.lineage import broadcast_within, cut, shuffled

#: Words of the longest shingle.
SHINGLE = 6
#: Records are covered in blocks of so many words, which bounds the work on a very long one.
BLOCK = 512
#: Counters of the two frequency sketches: fixed, whatever the corpus.
COUNTERS = 1 << 19
#: The map of indexed shingles has 2 to the power of so many bits: 16 to 32 for each shingle, at least and at most (128 MB).
LEAST_BITS, MOST_BITS = 20, 30
#: A worker fills the map in pieces of 2 to the power of so many bits (8 kB).
PIECE = 16
#: Parts into which the training rows of a shingle are split, so that a common one isn't one task.
SALTS = 8
#: 64-bit words of the parity signature.
SIGNATURE = 4

_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(tokens: list[str | None]) -> list[str]:
    """Words as read: pieces that begin with ``##`` joined to the word before, letter case, accents and
    punctuation disregarded. Null tokens and tokens of punctuation alone are no words."""
    whole: list[str] = []
    for t in tokens:
        if t is None:
            continue
        if t.startswith("##") and len(t) > 2 and whole:
            whole[-1] += t[2:]
        else:
            whole.append(t)
    return [w for t in whole if (w := _plain(t))]


def _plain(token: str) -> str:
    low = token.casefold()
    if low.isascii():
        return low if low.isalnum() else "".join(c for c in low if c.isalnum())
    return "".join(c for c in unicodedata.normalize("NFKD", low) if c.isalnum())


def read_words(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(``id``, ``words``) of the rows that have words; null, empty and wordless token arrays give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["id", "words"])
            yield out.filter(pa.array([bool(w) for w in words], pa.bool_()))

    rows = df.select(F.col(key).cast("bigint"), tokens).where(F.size(tokens) > 0)
    return rows.mapInArrow(run, "id bigint, words array<string>")


def distance_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether the edit distance between word lists is at most ``most``; bit-parallel, one step a word of ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    m = len(a)
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, left = full, 0, m, len(b)
    for w in b:
        here = places.get(w, 0)
        same = here | down
        across = (((here & up) + up) ^ up) | here
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & top) - bool(fall & top)
        left -= 1
        if score - left > most:
            return False
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(same | rise) & full, rise & same
    return score <= most


@pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance_within(list(x), list(y), max(len(x), len(y)) // 5) for x, y in zip(a, b, strict=True)], dtype=bool)


def _classes(words: DataFrame) -> DataFrame:
    """Rows with ``cls``, one for each different text."""
    return words.withColumn("cls", F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)))


def _texts(classes: DataFrame) -> DataFrame:
    """One row for each class: its least id, its words, their hashes and the parity signature."""
    one = classes.groupBy("cls").agg(F.min("id").alias("rep"), F.any_value("words").alias("words"))
    hashed = one.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    return hashed.select("rep", "n", "words", "h")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return flat.view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x * _P) >> np.uint64(64 - 19)).astype(np.int64)


def _pairs(flat: np.ndarray) -> np.ndarray:
    return flat[:-1] * _P + flat[1:] if len(flat) else flat


def _sketch(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words and of word pairs over all texts, in two fixed arrays of counters; only a guide to what is rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * COUNTERS, dtype=np.int64)
        for b in batches:
            flat, at = _lists(b.column(0))
            total[:COUNTERS] += np.bincount(_bucket(flat), minlength=COUNTERS)
            inner = np.ones(max(len(flat) - 1, 0), dtype=bool)
            inner[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(flat))] - 1] = False
            total[COUNTERS:] += np.bincount(_bucket(_pairs(flat)[inner]), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    sums = texts.select("h").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    total = np.zeros(2 * COUNTERS)
    total[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return total[:COUNTERS], total[COUNTERS:]


def most_operations(m: int) -> int:
    """The most operations that any near partner of a record of ``m`` words may take."""
    n = m
    while n + 1 - m <= (n + 1) // 5:
        n += 1
    return n // 5


def cover(costs: list[np.ndarray], need: list[int]) -> list[list[tuple[int, int]]]:
    """For each text the ``need`` disjoint shingles (place, length) of least total cost.

    ``costs[t][l - 1, i]`` is the cost of the shingle of ``l`` words at ``i``; texts of a call are solved together.
    """
    size, most, reach = len(costs), max(need), max(c.shape[1] for c in costs)
    cost = np.full((size, SHINGLE, reach), np.inf)
    for t, c in enumerate(costs):
        cost[t, :, : c.shape[1]] = c
    best = np.full((reach + 1, size, most + 1), np.inf)
    best[:, :, 0] = 0
    pick = np.zeros((reach + 1, size, most + 1), dtype=np.int8)
    for i in range(1, reach + 1):
        now, how = best[i], pick[i]
        now[:] = best[i - 1]
        for length in range(1, min(SHINGLE, i) + 1):
            new = best[i - length][:, :-1] + cost[:, length - 1, i - length, None]
            less = new < now[:, 1:]
            now[:, 1:][less] = new[less]
            how[:, 1:][less] = length
    told = []
    for t, c in enumerate(costs):
        i, k, out = c.shape[1], need[t], []
        while k:
            length = int(pick[i, t, k])
            if length:
                out.append((i - length, length))
                k -= 1
            i -= length or 1
        told.append(out)
    return told


def _costs(h: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Expected occurrences of each shingle, as a chain of word pairs."""
    m = len(h)
    one = np.log(words[_bucket(h)] + 0.5)
    two = np.log(pairs[_bucket(_pairs(h))] + 0.25)
    cost = np.full((SHINGLE, m), np.inf)
    cur = one
    cost[0] = np.exp(cur)
    for length in range(2, min(SHINGLE, m) + 1):
        k = m - length + 1
        cur = cur[:k] + two[length - 2 : length - 2 + k] - one[length - 2 : length - 2 + k]
        cost[length - 1, :k] = np.exp(cur)
    return cost


def _shingle(flat: np.ndarray, length: int) -> np.ndarray:
    """Key of the shingle of ``length`` words at each place (those that leave their text are cut by the caller)."""
    k = len(flat) - length + 1
    key = flat[:k]
    for j in range(1, length):
        key = key * _P + flat[j : j + k]
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    return key ^ key >> np.uint64(32)


def _signature(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text the parities of its word counts in 64 x SIGNATURE classes; one operation turns at most two."""
    bits = 64 * SIGNATURE
    cls = (flat * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)).astype(np.int64) % bits
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    odd = np.bincount(owner * bits + cls, minlength=(len(at) - 1) * bits).astype(np.uint8).reshape(-1, bits) & 1
    packed = np.packbits(odd, axis=1).view(np.int64)
    return [np.ascontiguousarray(packed[:, i]) for i in range(SIGNATURE)]


_SIG = [f"s{i}" for i in range(SIGNATURE)]


def _index(texts: DataFrame, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """The rarest covering shingles of each evaluation text: key, text, place, length of the text, signature."""
    counts = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = counts.value
        for b in batches:
            flat, at = _lists(b.column(1))
            blocks = []
            for t in range(b.num_rows):
                m = int(at[t + 1] - at[t])
                need, parts = most_operations(m) + 1, -(-m // BLOCK)
                for p in range(parts):
                    lo, hi = m * p // parts, m * (p + 1) // parts
                    if (k := need * hi // m - need * lo // m) > 0:
                        blocks.append((hi - lo, t, lo, k))
            blocks.sort()
            keys, places, owners = [], [], []
            for i in range(0, len(blocks), 64):
                some = blocks[i : i + 64]
                hs = [flat[at[t] + lo : at[t] + lo + n] for n, t, lo, _ in some]
                for (_, t, lo, _), h, got in zip(some, hs, cover([_costs(h, words, pairs) for h in hs], [x[3] for x in some]), strict=True):
                    for place, length in got:
                        keys.append(_shingle(h[place : place + length], length)[0])
                        places.append(lo + place)
                        owners.append(t)
            o = np.array(owners, dtype=np.int64)
            sizes, rep = np.diff(at).astype(np.int32), b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(rep[o]), pa.array(np.array(places, dtype=np.int32)), pa.array(sizes[o]), *(pa.array(s[o]) for s in _signature(flat, at))],
                ["key", "rep", "place", "n", *_SIG],
            )

    return texts.select("rep", "h").mapInArrow(run, "key bigint, rep bigint, place int, n int, " + ", ".join(f"{s} bigint" for s in _SIG))


def _map_of(index: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each indexed shingle, and the power of two of the bits; beyond MOST_BITS the map only lets more through.

    Workers fill pieces of the map; the driver takes one partition's pieces at a time, so that it holds the map once.
    """
    keys = cut(index.select("key").distinct())
    power = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))

    def piece(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE, dtype=bool)
        bits[(group.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - power)).astype(np.int64) & (1 << PIECE) - 1] = True
        return pa.table({"piece": group.column("piece")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    placed = keys.select(F.shiftrightunsigned("key", 64 - power + PIECE).cast("int").alias("piece"), "key")
    out = np.zeros(1 << power - 3, dtype=np.uint8)
    size = 1 << PIECE - 3
    for at, bits in placed.groupBy("piece").applyInArrow(piece, "piece int, bits binary").toLocalIterator():
        out[at * size : (at + 1) * size] = np.frombuffer(bits, dtype=np.uint8)
    return out.view("<u8"), power


def _probe(texts: DataFrame, bits: np.ndarray, power: int) -> DataFrame:
    """Every shingle of the training texts that the map of indexed shingles may hold."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                flat, at = _lists(b.column(1))
                sizes = np.diff(at)
                owner = np.repeat(np.arange(b.num_rows), sizes)
                place = np.arange(len(flat)) - at[:-1][owner]
                sig, rep = _signature(flat, at), b.column(0).to_numpy()
                for length in range(1, SHINGLE + 1):
                    if len(flat) < length:
                        break
                    key = _shingle(flat, length)
                    where = key >> np.uint64(64 - power)
                    k = len(key)
                    hit = (bits[(where >> np.uint64(6)).astype(np.int64)] >> (where & np.uint64(63)) & np.uint64(1)).astype(bool)
                    at_ = np.flatnonzero(hit & (place[:k] + length <= sizes[owner[:k]]))
                    o = owner[at_]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[at_].view(np.int64)), pa.array(rep[o]), pa.array(place[at_].astype(np.int32)), pa.array(sizes[o].astype(np.int32)), *(pa.array(s[o]) for s in sig)],
                        ["key", "rep", "place", "n", *_SIG],
                    )

    return texts.select("rep", "h").mapInArrow(run, "key bigint, rep bigint, place int, n int, " + ", ".join(f"{s} bigint" for s in _SIG))


def _matches(train: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str, tokens: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of near texts by their least ids ``t`` and ``v``, training rows with ``t``, evaluation rows with ``v``)."""
    t = cut(_classes(read_words(train, train_key, tokens)))
    v = cut(_classes(read_words(evaluation, eval_key, tokens)))
    tt, vt = cut(_texts(t)), cut(_texts(v))
    words, pairs = _sketch(tt)
    index = cut(_index(vt, words, pairs))
    a = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("a")
    b = _probe(tt, *_map_of(index)).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).alias("b")
    room = F.expr("greatest(a.n, b.n) div 5")
    right = F.abs((F.col("a.n") - F.col("a.place")) - (F.col("b.n") - F.col("b.place")))
    turned = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in _SIG), F.lit(0))
    near = (F.abs(F.col("a.place") - F.col("b.place")) + right <= room) & (turned <= 2 * room)
    found = shuffled(a).join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & near).select(F.col("b.rep").alias("t"), F.col("a.rep").alias("v")).distinct()
    some = broadcast_within(cut(found))
    tw = shuffled(tt.select(F.col("rep").alias("t"), F.col("words").alias("tw"))).join(some, "t")
    vw = shuffled(vt.select(F.col("rep").alias("v"), F.col("words").alias("vw"))).join(some, "v")
    told = tw.join(shuffled(vw), ["t", "v"]).where(_near("tw", "vw")).select("t", "v")
    least = lambda rows, name: rows.select("id", "cls").join(shuffled(rows.groupBy("cls").agg(F.min("id").alias(name))), "cls").select(name, "id")
    return told, least(t, "t"), least(v, "v")


def overlaps(train: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str, tokens: str = "tokens") -> DataFrame:
    """(``train_id``, ``eval_id``): every pair of a training and an evaluation record that are near each other.

    Rows whose tokens are null, empty or hold no word never count; copies inside a table count each. Equal texts
    are joined once and expanded at the end. Where both records have under five words they must be equal. Empty tables
    give no rows; columns other than the key and the tokens are not read.
    """
    told, t, v = _matches(train, evaluation, train_key, eval_key, tokens)
    return told.join(t.withColumnRenamed("id", "train_id"), "t").join(v.withColumnRenamed("id", "eval_id"), "v").select("train_id", "eval_id")


def links(train: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str, tokens: str = "tokens") -> DataFrame:
    """(``id``, ``links``): evaluation records with a near training record and how many there are, from the sizes of the groups of
    equal texts; no pair is expanded."""
    told, t, v = _matches(train, evaluation, train_key, eval_key, tokens)
    sizes = t.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return told.join(sizes, "t").groupBy("v").agg(F.sum("n").alias("links")).join(v, "v").select("id", "links")


def overlap_report(linked: DataFrame, evaluation: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """Per split and source of the evaluation record: records, records with an overlap (``linked``, see links), share and pairs.

    A missing source or split, however written, is reported as null; names that differ only in their spelling are one.
    """
    rows = evaluation.select(F.col(key).alias("id"), F.lower(F.trim(split)).alias("split"), named(F.col(source)).alias("source"), name_key(F.col(source)).alias("name"))
    joined = rows.join(linked, "id", "left")
    spelled = joined.groupBy("split", "name", "source").agg(F.count(F.lit(1)).alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
    per = spelled.groupBy("split", "name").agg(F.max_by("source", F.struct("records", "source")).alias("source"), *[F.sum(c).alias(c) for c in ("records", "overlapping", "pairs")])
    return per.select("split", "source", "records", "overlapping", (F.col("overlapping") / F.col("records")).alias("share"), "pairs")


def named(source: Column) -> Column:
    return F.when(name_key(source).isNotNull(), spelling(source))
