"""URL filters (operator 6): a memory-mapped sorted array of 64-bit digests.

A rule is a host and a path prefix (``example.com/en/``); it fits its host and all subdomains.
``DigestArray`` sorts the xxhash64 digests of all rules and lays them out in one file with the rules' full
strings. The file travels once to each executor, every worker memory-maps it, and
all of an executor's workers share its pages. A URL is probed with each suffix of its host at a dot, with
each rule path length there is; probes of a batch are answered by one vectorised binary
search, and a digest that is found counts only if the stored string is equal. The longest rule wins.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
path goes on to ``?``, ``#`` or the end. URLs that are null or lack ``://`` have an empty host and path. Without a
fitting rule the verdict is ``allow``, or ``block`` for an empty host: there is nothing to fetch. Extra columns are kept.

Rule lists above ``MAX_BYTES`` are refused: split them by host and apply one filter after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import new_path

MAX_BYTES = 1 << 30

# The rules of the registered query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


class DigestArray:
    """Digests in order, then offsets, verdicts and strings; built on the driver, mapped by workers."""

    def __init__(self, path: str):
        head = np.memmap(path, "<u8", "r", 0, (2,))
        n, size = int(head[0]), int(head[1])
        at = 16
        self.digest = np.memmap(path, "<u8", "r", at, (n,)) if n else np.zeros(0, np.uint64)
        self.offset = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
        self.allow = np.memmap(path, np.uint8, "r", at + 8 * n + 8 * (n + 1), (n,)) if n else np.zeros(0, np.uint8)
        self.text = np.memmap(path, np.uint8, "r", at + 8 * n + 8 * (n + 1) + n, (size,)) if size else np.zeros(0, np.uint8)
        paths = {len(self.string(i)) - self.string(i).index(b"/") for i in range(n)}
        self.lengths = sorted(paths)

    def string(self, i: int) -> bytes:
        return self.text[int(self.offset[i]) : int(self.offset[i + 1])].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The rule that equals each key, or -1. Equal digests lie side by side."""
        want = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digest, want, "left")
        end = np.searchsorted(self.digest, want, "right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(end > at):
            out[i] = next((k for k in range(at[i], end[i]) if self.string(k) == keys[i]), -1)
        return out

    @staticmethod
    def pack(rules: tuple[tuple[str, str], ...]) -> bytes:
        """The file's content from rules as (host/path, verdict); a repeated rule keeps its last verdict."""
        unique = {r.encode(): v == "allow" for r, v in rules}
        if any(b"/" not in r for r in unique):
            raise ValueError("a rule needs a path, at least /")
        order = sorted(unique, key=lambda r: (xxhash.xxh64_intdigest(r), r))
        data = b"".join(order)
        if len(data) + 17 * len(order) > MAX_BYTES:
            raise ValueError(f"rules exceed {MAX_BYTES} bytes")
        parts = (
            np.array([len(order), len(data)], "<u8").tobytes(),
            np.array([xxhash.xxh64_intdigest(r) for r in order], "<u8").tobytes(),
            np.concatenate(([0], np.cumsum([len(r) for r in order]))).astype("<u8").tobytes(),
            bytes(unique[r] for r in order),
            data,
        )
        return b"".join(parts)


def split(url: str | None) -> tuple[bytes, bytes]:
    """Host and path of a URL."""
    if url is None or "://" not in url:
        return b"", b""
    rest = url.encode().split(b"://", 1)[1]
    stop = min((i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find(b"/")
    return (rest.lower(), b"") if slash < 0 else (rest[:slash].lower(), rest[slash:])


def _judge(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    array = DigestArray(SparkFiles.get(name))
    for batch in batches:
        parts = [split(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
        keys, row = [], []
        for r, (host, path) in enumerate(parts):
            suffixes = [host] if host else []
            dot = host.find(b".")
            while dot >= 0:
                suffixes.append(host[dot + 1 :])
                dot = host.find(b".", dot + 1)
            for s in suffixes:
                for n in array.lengths:
                    if n <= len(path):
                        keys.append(s + path[:n])
                        row.append(r)
        found = array.probe(keys)
        best: list[int] = [-1] * len(parts)
        for k in np.flatnonzero(found >= 0).tolist():
            r, i = row[k], int(found[k])
            if best[r] < 0 or len(array.string(i)) > len(array.string(best[r])):
                best[r] = i
        rules = [array.string(i).decode() if i >= 0 else None for i in best]
        allow = [bool(array.allow[i]) if i >= 0 else bool(h) for i, (h, _) in zip(best, parts, strict=True)]
        added = [
            pa.array([h.decode() for h, _ in parts], pa.string()), pa.array([p.decode() for _, p in parts], pa.string()),
            pa.array(rules, pa.string()), pa.array(["allow" if a else "block" for a in allow], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*batch.schema.names[:-1], *ADDED])


ADDED = ("host", "path", "rule", "verdict")


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in the shared folder, through the file system that the folder is on."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    spark, names = pages.sparkSession, pages.columns
    path = new_path(spark, "url-rules")
    name = path.rsplit("/", 1)[1]
    _write(spark, path, DigestArray.pack(tuple(rules)))
    spark.sparkContext.addFile(path)
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{url_col}`").cast("string").alias("_url"))
    kind = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.StringType()) for c in ADDED]])
    done = rows.mapInArrow(lambda it: _judge(it, name), kind)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ADDED], *ADDED)
