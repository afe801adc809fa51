"""Line dedup (operator 1): sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII whitespace at its ends and with A-Z lower-cased.
``LineIndex`` keeps, under one shared folder,

* ``log``: one row per (key, document) and insertion or deletion, with sign +1 or -1;
* ``counts``: the exact reference counts that the log sums to, for keys in at least ``min_docs`` documents,
  with the largest document id that holds the key;
* ``filters``: one cuckoo filter per shard of the key space, over the keys in ``counts``.

Inserting or deleting documents appends to the log, recounts, and puts the keys that
crossed ``min_docs`` into the filters or takes them out, so a deletion undoes an
insertion exactly. ``clean`` screens lines against the filters, confirms the hits in the exact counts, and drops
the confirmed ones outside the largest document. Documents without a hit never leave their task.

Null or empty texts are one empty line. Rows with the same id are one document for the
counts, and each is cleaned. A null id is never the largest one, and is not counted.
Extra columns are ignored by the index and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.cuckoo import CuckooFilter, build
from ledgerloom.llm.tables import stage
from ledgerloom.llm.text import whole
from ledgerloom.session import new_path

SPACE = b" \t\n\x0b\x0c\r"
SCREEN_BYTES = 32 << 20  # filters beyond this are not sent to every task; the exact join then decides alone
CONFIRM_ROWS = 1 << 20  # repeated lines whose exact counts go to every task; beyond it they are joined
SHARD_KEYS = 1 << 18


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line, or None for lines too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), whole(batch.column(1)), strict=True):
            lines = text.as_buffer().to_pybytes().split(b"\n")
            own = {line_key(x, min_chars) for x in lines} - {None}
            ids += [doc] * len(own)
            found += own
        pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(ids, pa.int64())], ["k1", "k2", "doc"]
        )


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(k1, k2, doc): each document's distinct keys."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _keys(it, min_chars), "k1 long, k2 long, doc long")


def _filter_shard(key: tuple, group: pa.Table) -> pa.Table:
    """One shard's filter after its changes; rebuilt from its keys when it gets too full."""
    data = {n: group.column(n).to_pylist() for n in ("filter", "change")}
    keys = group.column("k1").to_numpy().view(np.uint64)
    change = np.array([c if c is not None else 9 for c in data["change"]])
    old = next((f for f in data["filter"] if f is not None), None)
    if old is None:
        f = build(keys[(change == 0) | (change == 1)])
    else:
        f = CuckooFilter.load(old)
        f.delete(keys[change == -1])
        if not f.insert(keys[change == 1]):
            f = build(keys[(change == 0) | (change == 1)])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})


class LineIndex:
    def __init__(self, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5):
        self.spark, self.id_col, self.text_col = spark, id_col, text_col
        self.min_chars, self.min_docs = min_chars, min_docs
        self.root = new_path(spark, "line-index")
        self.parts = 0
        self.shards = 1
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._append(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """``docs`` as they were inserted."""
        return self._append(docs, -1)

    def _append(self, docs: DataFrame, sign: int) -> LineIndex:
        keys = line_keys(docs, self.id_col, self.text_col, self.min_chars).where("doc is not null")
        path = f"{self.root}/log/part={self.parts}"
        keys.withColumn("sign", F.lit(sign)).write.parquet(path)
        self.parts += 1
        self._recount()
        return self

    def _recount(self) -> None:
        log = self.spark.read.parquet(f"{self.root}/log").drop("part")
        held = log.groupBy("k1", "k2", "doc").agg(F.sum("sign").alias("sign")).where("sign > 0")
        counts = held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"), F.max("doc").alias("keeper"))
        counts = stage(counts.where(F.col("refs") >= self.min_docs), "line-counts")
        n = counts.count()
        if self.filters is None or n > 2 * self.shards * SHARD_KEYS:
            self.shards, self.filters = max(1, -(-n // SHARD_KEYS)), None
        self.filters = self._refilter(counts)
        self.counts = counts

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.col("k2"), F.lit(self.shards)).cast("int"))

    def _refilter(self, counts: DataFrame) -> DataFrame:
        now = counts.select("k1", "k2", F.lit(1).alias("now"))
        nothing = F.lit(None).cast("binary").alias("filter")
        if self.filters is None:
            rows = now.select("k1", "k2", F.lit(0).alias("change"), nothing)
            rows = self._shard(rows)
        else:
            was = self.counts.select("k1", "k2", F.lit(1).alias("was"))
            change = F.when(F.col("was").isNull(), 1).when(F.col("now").isNull(), -1).otherwise(0)
            rows = self._shard(now.join(was, ["k1", "k2"], "full").select("k1", "k2", change.alias("change"), nothing))
            old = self.filters.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(None).cast("int").alias("change"), "filter", "shard")
            rows = rows.unionByName(old)
        return stage(rows.groupBy("shard").applyInArrow(_filter_shard, "shard int, filter binary"), "line-filters")

    def _screen(self) -> dict[int, bytes] | None:
        """The filters by shard if all of them are small enough for every task."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        return {r["shard"]: r["filter"] for r in self.filters.collect()} if size <= SCREEN_BYTES else None

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc, k1, k2) of the lines that ``clean`` drops from these documents."""
        keys = line_keys(docs, self.id_col, self.text_col, self.min_chars)
        return keys.join(self.counts, ["k1", "k2"]).where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "k1", "k2")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``kept_text``, ``n_lines``, ``n_dropped`` and ``kept_sha256`` added.

        Where the exact counts of repeated lines are few (``CONFIRM_ROWS``) they go to every task beside
        the filters and one scan does it all. Beyond that, hits are confirmed by a join; only
        documents with hits are moved for it.
        """
        names, min_chars = docs.columns, self.min_chars
        screen = self.spark.sparkContext.broadcast(self._screen())
        shards = self.shards
        columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
        rows = docs.select(*columns, F.col(f"`{self.id_col}`").cast("long").alias("_doc"), F.col(f"`{self.text_col}`").cast("string").alias("_text"))
        own = [f for f in rows.schema.fields if f.name.startswith("c")]
        added = T.StructType().add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
        final = T.StructType([*own, *added.fields])

        if self.counts.count() <= CONFIRM_ROWS:
            exact = self.spark.sparkContext.broadcast({(r["k1"], r["k2"]): r["keeper"] for r in self.counts.collect()})

            def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = _load(screen.value)
                for batch in batches:
                    docs_, texts = batch.column("_doc").to_pylist(), batch.column("_text")
                    hits = _hits(texts, min_chars, shards, held).to_pylist()
                    drops = [{_bytes(h) for h in hs if exact.value.get((h["k1"], h["k2"]), d) != d} for d, hs in zip(docs_, hits, strict=True)]
                    yield _rebuilt(batch, texts, drops, min_chars)

            done = rows.mapInArrow(one_pass, final)
        else:

            def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = _load(screen.value)
                for batch in batches:
                    hits = _hits(batch.column("_text"), min_chars, shards, held)
                    yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, "_hits"])

            def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    drops = [{_bytes(h) for h in hs or []} for hs in batch.column("_set").to_pylist()]
                    yield _rebuilt(batch, batch.column("_text"), drops, min_chars)

            pair = "array<struct<k1:bigint,k2:bigint>>"
            key = T.StructType().add("k1", "long").add("k2", "long")
            fields = T.StructType([*rows.schema.fields]).add("_hits", T.ArrayType(key))
            seen = stage(rows.mapInArrow(look, fields).withColumn("_row", F.monotonically_increasing_id()), "line-hits")
            sure = seen.where(F.size("_hits") == 0).drop("_hits", "_row").withColumn("_set", F.lit(None).cast(pair))
            maybe = seen.where(F.size("_hits") > 0)
            hits = maybe.select("_row", "_doc", F.explode("_hits").alias("h")).select("_row", "_doc", "h.k1", "h.k2")
            confirmed = hits.join(self.counts, ["k1", "k2"]).where(~F.col("_doc").eqNullSafe(F.col("keeper")))
            drops = stage(confirmed.groupBy("_row").agg(F.collect_set(F.struct("k1", "k2")).alias("_set")), "line-drops")
            maybe = maybe.drop("_hits").join(drops.hint("shuffle_hash"), "_row", "left").drop("_row")
            done = sure.unionByName(maybe).mapInArrow(rebuild, final)
        new = added.names
        return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in new], *new)


def _load(filters: dict[int, bytes] | None) -> dict[int, CuckooFilter] | None:
    return None if filters is None else {s: CuckooFilter.load(f) for s, f in filters.items()}


def _bytes(key: dict) -> bytes:
    return np.array([key["k1"], key["k2"]], "<i8").tobytes()


def _rebuilt(batch: pa.RecordBatch, texts: pa.Array, drops: list[set[bytes]], min_chars: int) -> pa.RecordBatch:
    """The batch's own columns and the texts without the dropped lines."""
    kept, lines, gone, digest = [], [], [], []
    for text, drop in zip(whole(texts), drops, strict=True):
        joined = text.as_buffer().to_pybytes()
        n = joined.count(b"\n") + 1
        rest = n
        if drop:
            keep = [x for x in joined.split(b"\n") if line_key(x, min_chars) not in drop]
            joined, rest = b"\n".join(keep), len(keep)
        kept.append(joined)
        lines.append(n)
        gone.append(n - rest)
        digest.append(hashlib.sha256(joined).hexdigest())
    new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
    own = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.startswith("c")]
    return pa.RecordBatch.from_arrays([*[c for _, c in own], *new], [*[n for n, _ in own], "kept_text", "n_lines", "n_dropped", "kept_sha256"])


def _hits(texts: pa.Array, min_chars: int, shards: int, held: dict[int, CuckooFilter] | None) -> pa.Array:
    """For each text its distinct keys that the filters may hold, or all keys without filters."""
    counts, found = [], []
    for text in whole(texts):
        own = {line_key(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")} - {None}
        counts.append(len(own))
        found += own
    pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
    row = np.repeat(np.arange(len(counts)), counts)
    if held is not None:
        ok = np.zeros(len(pairs), bool)
        shard = np.mod(pairs[:, 1], shards)
        for s, f in held.items():
            at = np.flatnonzero(shard == s)
            ok[at] = f.contains(pairs[at, 0].copy().view(np.uint64))
        pairs, row = pairs[ok], row[ok]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(counts)))))
    values = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["k1", "k2"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One pass over one table: insert everything, then clean it."""
    return LineIndex(docs.sparkSession, id_col, text_col, min_chars, min_docs).insert(docs).clean(docs)
