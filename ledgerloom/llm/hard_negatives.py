"""Hard-negative mining (operator 11): a secondary sort on (anchor, descending score, id) and a streaming pass over it.

A row's score is the integer inner product of its components, each ``floor(scale * x)``, with the anchor's. Higher scores come
first, ties by smaller id. An anchor's positives are its first rows of the same label; a positive of score p opens a window, and
the first rows of other labels with ``low * p <= 100 * score <= high * p`` are its negatives.

1. Anchors go to the tasks in chunks of ``ANCHORS`` rows and ``CHUNK_BYTES`` bytes at most. A task multiplies its rows
   with a chunk tile by tile and keeps the first few positives of each anchor, so an anchor gives each task a few pairs, however many rows there are.
2. These pairs are packed into (anchor, falling score, kind, id) keys, dealt by anchor and sorted inside partitions; a
   streaming iterator takes the first ones of each anchor. They are its positives, and their windows are sent back with the chunk.
3. A second scan keeps, per task, the first few negatives of each window.
4. Positives and negatives are dealt and sorted in the same way. The iterator opens a window at each positive and
   emits the negatives that fall into open windows; it holds the open windows of one anchor, never an anchor's rows.

Each chunk's tables are written to the shared folder before the next one starts. The result is exact: what a task leaves out has
enough better rows in the same task.

Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors are scored against
anchors of as many components only (an empty vector: score 0 with other empty ones). Negative positives open no window. Rows that repeat an id and a score
count once. A row that has the anchor's id is neither its positive nor its negative; where several rows repeat an anchor's id, the one with the
smallest (label, vector) is the anchor. Scaled components beyond 64 bits and scores beyond 64 bits saturate. An empty table, or one without anchors, gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.share import Shared
from ledgerloom.llm.tables import stage

ANCHORS = 16_384
CHUNK_BYTES = 32 << 20
TILE = 1 << 19  # scores held at a time
PENDING = 1 << 17  # candidates gathered before they are merged

MOST = (1 << 63) - 1
NONE = np.int64(-MOST - 1)  # below every score

KEY = "anchor long, fall long, kind int, id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as doubles; those beyond 64 bits become the nearest double inside."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(scale)), -float(1 << 63), float(MOST - 1023))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, one line per anchor."""
    reach = max(1, anchors.shape[1]) * float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if reach < 1 << 53:  # no sum leaves the integers that doubles hold
        return (anchors @ rows.T).astype(np.int64)
    exact = [[min(max(sum(x * y for x, y in zip(a, b, strict=True)), -MOST), MOST) for b in (list(map(int, r)) for r in rows)] for a in (list(map(int, r)) for r in anchors)]
    return np.array(exact, np.int64).reshape(len(anchors), len(rows))


class First:
    """For each slot the first ``k`` candidates seen so far: highest score, then smallest id, repeats once."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.least = np.full(slots, NONE)  # lower scores don't get in any more
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.waiting.append((slot, score, ids))
            self.n += len(slot)
            if self.n > max(PENDING, len(self.kept[0])):
                self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        if self.waiting:
            slot, score, ids = (np.concatenate(v) for v in zip(self.kept, *self.waiting, strict=True))
            self.waiting, self.n = [], 0
            order = np.lexsort((ids, -score, slot))
            slot, score, ids = slot[order], score[order], ids[order]
            new = np.ones(len(slot), bool)
            new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
            slot, score, ids = slot[new], score[new], ids[new]
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
            last = rank == self.k - 1
            self.least[slot[last]] = score[last]
            self.kept = tuple(v[rank < self.k] for v in (slot, score, ids))
        return self.kept


class Chunk:
    """Anchors of one dimension, and the windows that their positives open once these are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low = self.high = np.zeros((len(ids), 0), np.int64)

    def open(self, positives: dict[int, list[int]], k: int, low: int, high: int) -> None:
        self.low, self.high = np.zeros((len(self.ids), k), np.int64), np.full((len(self.ids), k), NONE)
        for i, anchor in enumerate(self.ids.tolist()):
            for j, p in enumerate(positives.get(anchor, ())):
                self.low[i, j], self.high[i, j] = window(p, low, high)


def window(p: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and largest score inside."""
    return -(-low * p // 100), high * p // 100


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, labels, integer vectors) of each batch."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield dim, part.column("id").to_numpy(), part.column("label").to_numpy(), integers(flat.reshape(part.num_rows, dim), scale)


def _tiles(chunk: Chunk, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[tuple]:
    step = max(1, TILE // max(1, len(ids)))
    for at in range(0, len(chunk.ids), step):
        own = slice(at, at + step)
        score = products(chunk.vectors[own], vectors)
        alike = chunk.labels[own, None] == labels[None]
        yield at, own, score, alike, chunk.ids[own, None] != ids[None]


def _pairs(chunk: Chunk, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(anchor), 1 << 16):
        own = slice(at, at + (1 << 16))
        n = len(anchor[own])
        columns = [chunk.ids[anchor[own]], -score[own], np.full(n, kind, np.int32), ids[own]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "fall", "kind", "id"])


def _first_positives(batches: Iterator[pa.RecordBatch], chunks: dict[int, Chunk], scale: int, k: int) -> Iterator[pa.RecordBatch]:
    best = {dim: First(len(c.ids), k) for dim, c in chunks.items()}
    for dim, ids, labels, vectors in _blocks(batches, scale):
        if dim in chunks:
            for at, own, score, alike, other in _tiles(chunks[dim], ids, labels, vectors):
                a, b = np.nonzero(alike & other & (score >= best[dim].least[own, None]))
                best[dim].add(a + at, score[a, b], ids[b])
    for dim, first in best.items():
        yield from _pairs(chunks[dim], *first.merge(), 0)


def _first_negatives(batches: Iterator[pa.RecordBatch], chunks: dict[int, Chunk], scale: int, k: int) -> Iterator[pa.RecordBatch]:
    best = {dim: First(c.low.size, k) for dim, c in chunks.items()}
    for dim, ids, labels, vectors in _blocks(batches, scale):
        if dim not in chunks:
            continue
        chunk, first = chunks[dim], best[dim]
        windows = chunk.low.shape[1]
        least = first.least.reshape(chunk.low.shape)
        for at, own, score, alike, other in _tiles(chunk, ids, labels, vectors):
            unlike = ~alike & other
            for j in range(windows):
                low = np.maximum(chunk.low[own, j], least[own, j])
                a, b = np.nonzero(unlike & (score <= chunk.high[own, j, None]) & (score >= low[:, None]))
                first.add((a + at) * windows + j, score[a, b], ids[b])
    for dim, first in best.items():
        slot, score, ids = first.merge()
        found = np.unique(np.stack([slot // max(1, chunks[dim].low.shape[1]), score, ids]), axis=1)  # windows overlap
        yield from _pairs(chunks[dim], *found, 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    """The sorted keys, repeats once."""
    last = None
    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("anchor", "fall", "kind", "id")), strict=True):
            if key != last:
                yield key
            last = key


def _table(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1 << 13:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _take(keys: Iterator[tuple[int, int, int, int]], k: int) -> Iterator[tuple]:
    anchor, n = None, 0
    for key in keys:
        n = n + 1 if key[0] == anchor else 1
        anchor = key[0]
        if n <= k:
            yield key


def _mine(keys: Iterator[tuple[int, int, int, int]], k: int, low: int, high: int) -> Iterator[tuple]:
    anchor, windows = None, []
    for own, fall, kind, i in keys:
        if own != anchor:
            anchor, windows = own, []
        score = -fall
        if kind == 0:
            least, most = window(score, low, high)
            if least <= most:
                windows.append([i, score, least, most, 0])
            continue
        for w in windows:
            if w[2] <= score <= w[3] and w[4] < k:
                w[4] += 1
                yield anchor, w[0], w[4], i, w[1], score


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("anchor").sortWithinPartitions("anchor", "fall", "kind", "id")


KEY_ARROW = [("anchor", pa.int64()), ("fall", pa.int64()), ("kind", pa.int32()), ("id", pa.int64())]
MINED_ARROW = [(c, pa.int32() if c == "rank" else pa.int64()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``rank`` counts from 1 within an anchor's positive."""
    spark = vectors.sparkSession
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    anchors = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a"))
    anchors = stage(anchors.select("id", "a.label", "a.vector", F.size("a.vector").alias("dim")), "anchors")
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))).first()
    chunks = max(-(-n // ANCHORS), -(-width // CHUNK_BYTES))
    rows = rows.select("id", "label", "vector", F.size("vector").alias("dim"))
    out = [spark.createDataFrame([], MINED)]
    for number in range(chunks):
        taken = anchors.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == number).toArrow()
        held = {dim: Chunk(ids, labels, x) for dim, ids, labels, x in _blocks(iter(taken.combine_chunks().to_batches()), scale)}
        sent = Shared(spark, held)
        found = rows.mapInArrow(lambda it, sent=sent: _first_positives(it, sent.value, scale, positives), KEY)
        first = _sorted(found).mapInArrow(lambda it: _table(_take(_keys(it), positives), pa.schema(KEY_ARROW)), KEY)
        first = stage(first, "positives")
        scores: dict[int, list[int]] = {}
        for anchor, fall in zip(*(c.to_pylist() for c in first.select("anchor", "fall").toArrow().columns), strict=True):
            scores.setdefault(anchor, []).append(-fall)
        for chunk in held.values():
            chunk.open(scores, positives, low, high)
        sent.close()
        sent = Shared(spark, held)
        found = rows.mapInArrow(lambda it, sent=sent: _first_negatives(it, sent.value, scale, negatives), KEY)
        mined = _sorted(found.union(first)).mapInArrow(lambda it: _table(_mine(_keys(it), negatives, low, high), pa.schema(MINED_ARROW)), MINED)
        out.append(stage(mined, "hard-negatives"))
        sent.close()
    return reduce(DataFrame.union, out)
