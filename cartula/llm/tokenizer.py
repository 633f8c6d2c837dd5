"""Byte-level BPE over whole corpora: greedy longest match, checked pair by pair, merged exactly where it fails.

A sequence of tokens is the encoding of its bytes exactly when every adjacent pair is what the merges would give
for that pair alone. So each word is first cut greedily into the longest tokens of the vocabulary; all adjacent
pairs of a batch are then tested at once in arrays, undoing merges from the pair's border outwards; only the words
with a failing pair are merged one by one.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every function takes another path.
TOKENIZERS = os.environ.get("CARTULA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"

# The published pattern that splits text before the merges of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose encoding a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 stands for itself."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder of one vocabulary file (tokenizers' JSON of a byte-level BPE whose ids follow the merges)."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        n = max(self.ids.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.rank = np.zeros(n, dtype=np.int64)  # 0 for a byte, else the place of its merge, from 1
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = model["vocab"]
        codes, made = [], []
        for k, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, m = vocab[a], vocab[b], vocab[a + b]
            self.left[m], self.right[m], self.rank[m] = i, j, k
            self.merges[i, j] = (k, m)
            codes.append(i << 32 | j)
            made.append(k)
        order = np.argsort(codes)
        self.codes, self.made = np.array(codes, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]
        self.longest: dict[bytes, int] = {}
        for word in self.ids:
            self.longest[word[:2]] = max(self.longest.get(word[:2], 0), len(word))
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def propose(self, word: bytes) -> list[int]:
        """The longest token of the vocabulary from the start, again and again."""
        ids, longest, out, i, n = self.ids, self.longest, [], 0, len(word)
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether the merges, run on its bytes alone, give that pair.

        Undoes the later of the two tokens' merges step by step. The pair fails when at some border two
        parts would have merged before the parts that now stand there were made.
        """
        ok = np.ones(len(a), dtype=bool)
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            code = a << 32 | b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            bad = (self.codes[at] == code) & (self.made[at] < limit)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            # the left token's merge goes first on equal places: of two like merges the left one is made first
            undo_a = ra > rb
            go = ~bad & ((ra > 0) | (rb > 0))
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding of one word by its merges in order; long words use a heap."""
        import heapq

        ids, merges = [self.ids[bytes([x])] for x in word], self.merges
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(k, i, x, y, m) for k, m, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, m = heapq.heappop(heap)
            j = after[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (found := merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (found[0], p, ids[p], ids[q], found[1]))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words not met before and remember them."""
        raw = [w.encode() for w in words]
        told = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, told), dtype=np.int64, count=len(told))
        flat = np.fromiter((t for ids in told for t in ids), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(told)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.array([], dtype=np.int64)
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fine = self.fits(pairs >> 32, pairs & 0xFFFFFFFF)
        for k in np.unique(owner[inner[~fine[back]]]):
            told[k] = self.merge(raw[k])
        self.known.update(zip(words, told, strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, without special tokens; an empty or null text gives an empty list."""
        split = [self.split.findall(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for ws in split for w in ws}
        self.learn(sorted(new))
        known = self.known
        return [[t for w in ws for t in known[w]] for ws in split]


@functools.lru_cache(maxsize=2)
def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_made: dict[int, ByteBpe] = {}


def _worker(file) -> ByteBpe:
    """One encoder in each Python worker for each vocabulary."""
    raw = file.value
    key = hash(raw)
    if key not in _made:
        _made[key] = ByteBpe(raw)
    return _made[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file as a broadcast (about 1.5 MB, whatever the corpus)."""
    return spark.sparkContext.broadcast(_read(path or os.path.join(TOKENIZERS, BYTE_BPE_50K)))


def _chunks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """(``key``, ``ids``): the token ids of each row's whole text, one narrow stage, no shuffle.

    Null and empty texts give an empty list, blank texts the ids of their white space. A very long text is one
    row of its batch; a word of any length is merged in n log n steps. Rows repeat as they come; other columns
    are not read. An empty table gives an empty frame.
    """
    file = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(file)
        for whole in batches:
            for b in _chunks(whole):
                told = bpe.encode(b.column(1).to_pylist())
                offsets = np.zeros(len(told) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in told], out=offsets[1:])
                flat = np.fromiter((t for x in told for t in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(ids))


def count_tokens(df: DataFrame, text: str, name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``name``: how many tokens the text takes (0 for null and empty)."""
    file = vocabulary(df.sparkSession, path)
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(file)
        for whole in batches:
            for b in _chunks(whole):
                n = [len(x) for x in bpe.encode(b.column(b.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*others, name])

    from pyspark.sql import types as T

    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(name, T.LongType())])
    return df.select(*others, text).mapInArrow(run, schema)
