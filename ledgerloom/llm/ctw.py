"""LM scoring (operator 4): context-tree weighting over bytes, and a unigram base over words.

The model predicts each byte of a text (UTF-8, then one end symbol, byte 0) from the ``DEPTH`` bytes before it,
zeros before the first. A byte is eight binary decisions; each decision has its own
tree of contexts of 0 to ``DEPTH`` bytes. A node's two counts give its Krichevsky-Trofimov probability, and the tree weights
every node half as a leaf and half as the product of its children. What training leaves at a node is the
posterior weight of stopping there; a decision's probability mixes the KT estimates of all depths on its path by these weights, down to the
deepest context that training has seen. The two outcomes of a decision sum to one, and so do the 256 byte values.

Spark counts, over all documents, how often each run of ``DEPTH + 1`` bytes occurs, in training and
anywhere, and the same for words. Contexts that share their last three bytes are evaluated in one task; the shorter
depths are summed from those (at most 65536 x 255 rows of 16 bytes, whatever the corpus). The result is one row per run of bytes: its log probability. Scoring sums
these over whole texts: the most frequent runs and words (``HEAD``) go to every task, and what a text has beyond them is
joined, as (row, run, count). Nothing is left out: runs that occur only outside training are rows as well.

Null texts are empty. All rows are scored, repeated ids too. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.share import Shared
from ledgerloom.llm.tables import partitions, stage
from ledgerloom.llm.text import C1, U, longs, slices, whole

DEPTH = 5
TOP = 3  # contexts that share so many bytes are evaluated together
AT_ONCE = 50_000  # runs a task evaluates at a time, or one group of contexts
HEAD_RUNS = 1 << 20
HEAD_WORDS = 1 << 18
FLUSH_RUNS, FLUSH_WORDS = 800_000, 150_000  # distinct ones that a task holds before it passes them on
LOG10 = math.log(10)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by the recurrence up to 8 and Stirling's series from there."""
    shift = np.zeros_like(x, dtype=float)
    x = x.astype(float).copy()
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    r = 1 / x
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1.0)


def byte_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and each text's end: the byte under its context as one integer; and each text's first."""
    column = whole(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    padded = np.zeros(len(raw) + DEPTH * (len(column) + 1), np.uint8)
    begin = offsets[:-1] - offsets[0] + DEPTH * np.arange(1, len(column) + 1)
    for source, to, n in zip(offsets[:-1] - offsets[0], begin, length, strict=True):
        padded[to : to + n] = raw[source : source + n]
    out = np.zeros(len(padded) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << U(8)) | padded[k : len(padded) - DEPTH + k]
    # Text bytes and the first zero after them; the other zeros are only context.
    wanted = np.zeros(len(out) + 1, np.int8)
    np.add.at(wanted, begin - DEPTH, 1)
    np.add.at(wanted, begin - DEPTH + length + 1, -1)
    return out[np.cumsum(wanted[:-1]).astype(bool)], np.concatenate(([0], np.cumsum(length + 1)))


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        return keys[begin], np.diff(np.append(begin, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[begin], np.add.reduceat(counts[order], begin) if len(begin) else np.zeros(0, np.int64)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    def out() -> pa.RecordBatch:
        # Twice the run, plus one for training: runs have 48 bits.
        keys, counts = merged()
        return pa.RecordBatch.from_arrays([pa.array((keys >> U(1)).astype(np.int64)), pa.array((keys & U(1)).astype(np.int64) * counts), pa.array(counts)], ["run", "n", "seen"])

    for batch in batches:
        for piece in slices(batch, "text"):
            runs, first = byte_runs(piece.column("text"))
            train = np.repeat(piece.column("train").to_numpy(zero_copy_only=False), np.diff(first)).astype(np.uint64)
            held.append(_tally((runs << U(1)) | train))
            if sum(len(k) for k, _ in held) > FLUSH_RUNS:
                held = [merged()]
                if len(held[0][0]) > FLUSH_RUNS // 2:
                    yield out()
                    held = []
    if held:
        yield out()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    train: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        both = seen + train
        keys = list(both)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([train[k] for k in keys], pa.int64()), pa.array(list(both.values()), pa.int64())], ["word", "c", "seen"]
        )

    for batch in batches:
        for text, known in zip(whole(batch.column("text")), batch.column("train").to_pylist(), strict=True):
            (train if known else seen).update(text.as_buffer().to_pybytes().lower().split())
        if len(seen) + len(train) > FLUSH_WORDS:
            yield out()
            seen.clear()
            train.clear()
    if seen or train:
        yield out()


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each byte: node (1 to 255) and bit, one row of eight per byte."""
    b = byte.astype(np.int64)[:, None] | 256
    shift = np.arange(8, 0, -1)
    return b >> shift, (b >> (shift - 1)) & 1


def evaluate(run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For runs that share the last ``TOP`` context bytes: each decision's probability from that depth down, -1 where training
    has not seen it there; and (context and node, zeros, ones, log weighted probability) at that depth."""
    node, bit = decisions(run & U(255))
    node, bit = node.ravel().astype(np.uint64), bit.ravel().astype(bool)
    context = np.repeat(run >> U(8), 8)
    count = np.repeat(n, 8).astype(float)
    below_log: tuple[np.ndarray, np.ndarray] | None = None
    p = np.full(len(node), -1.0)
    upper: tuple[np.ndarray, ...] = ()
    for depth in range(DEPTH, TOP - 1, -1):
        # At most 40 bits of context and 8 of node: one key.
        key = ((context & U((1 << (8 * depth)) - 1)) << U(8)) | node
        keys, at = np.unique(key, return_inverse=True)
        ones = np.bincount(at, count * bit, len(keys))
        zeros = np.bincount(at, count * ~bit, len(keys))
        kt = log_kt(zeros, ones)
        if below_log is None:
            weighted, stop = kt, np.ones(len(keys))
        else:
            child_key, child = below_log
            parent = ((child_key >> U(8)) & U((1 << (8 * depth)) - 1)) << U(8) | (child_key & U(255))
            split = np.bincount(np.searchsorted(keys, parent), child, len(keys))
            weighted = np.logaddexp(kt, split) - math.log(2)
            stop = np.exp(kt - math.log(2) - weighted)
        estimate = np.where(bit, ones[at] + 0.5, zeros[at] + 0.5) / (zeros[at] + ones[at] + 1)
        met = (zeros + ones)[at] > 0
        mixed = np.where(p >= 0, stop[at] * estimate + (1 - stop[at]) * p, estimate)
        p = np.where(met, mixed, -1.0)
        below_log = (keys, weighted)
        upper = (keys, zeros, ones, weighted)
    return p.reshape(-1, 8), upper


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``evaluate`` for a partition that holds whole groups, some groups at a time."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    run = np.concatenate([b.column("run").to_numpy() for b in held]).view(np.uint64)
    n = np.concatenate([b.column("n").to_numpy() for b in held])
    top = (run >> U(8)) & U((1 << (8 * TOP)) - 1)
    order = np.argsort(top, kind="stable")
    run, n, top = run[order], n[order], top[order]
    begin = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    piece = begin // AT_ONCE
    cuts = [*begin[np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))], len(run)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        p, (key, zeros, ones, weighted) = evaluate(run[lo:hi], n[lo:hi])
        m, k = hi - lo, len(key)
        none = np.zeros(m)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([longs(run[lo:hi]), np.full(k, -1)])),
                pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(0, 8 * m + 1, 8), np.full(k, 8 * m)]), pa.int32()), pa.array(p.ravel().astype(np.float32))),
                pa.array(np.concatenate([none, (key >> U(8)) & U(0xFFFF)]).astype(np.int32)),
                pa.array(np.concatenate([none, key & U(255)]).astype(np.int32)),
                pa.array(np.concatenate([none, zeros])), pa.array(np.concatenate([none, ones])), pa.array(np.concatenate([none, weighted])),
            ],
            ["run", "p", "two", "node", "zeros", "ones", "weighted"],
        )


def _mixed(stop: np.ndarray, less: np.ndarray, met: np.ndarray, bit: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A depth's probability of each bit from its own estimate (see ``Upper``) and the one from below (-1: none there)."""
    rare = np.abs(less)
    own = np.where(bit == (less > 0), rare, 1 - rare)
    return np.where(met, np.where(below >= 0, stop * own + (1 - stop) * below, own), -1.0)


class Upper:
    """The depths above ``TOP``: per context and node the weight of stopping and the KT estimate of the rarer bit, negative if that is zero.

    The rarer one, because beyond 2^24 counts four bytes round the other to 1 and would leave nothing for it.
    """

    def __init__(self, two: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
        self.levels = []
        key = two.astype(np.int64) << 8 | node
        for shift in (8, 8, 0):
            order = np.argsort(key, kind="stable")
            key, zeros, ones, children = key[order], zeros[order], ones[order], children[order]
            kt = log_kt(zeros, ones)
            weighted = np.logaddexp(kt, children) - math.log(2)
            stop, less = np.exp(kt - math.log(2) - weighted), np.where(ones <= zeros, ones + 0.5, -(zeros + 0.5)) / (zeros + ones + 1)
            self.levels.append((key, stop.astype(np.float32), less.astype(np.float32)))
            if shift:
                # One byte of context less: the older of two, then the last one.
                parent = key & 0xFFFF if len(self.levels) == 1 else key & 0xFF
                key, at = np.unique(parent, return_inverse=True)
                zeros, ones, children = (np.bincount(at, x, len(key)) for x in (zeros, ones, weighted))

    def log10(self, run: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 of each run's last byte given the others."""
        node, bit = decisions(run & U(255))
        context = (run >> U(8)).astype(np.int64)[:, None]
        bit = bit.astype(bool)
        for (key, stop, less), mask in zip(self.levels, (0xFFFF, 0xFF, 0), strict=True):
            want = (context & mask) << 8 | node
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            met = key[at] == want if len(key) else np.zeros(want.shape, bool)
            p = _mixed(stop[at], less[at], met, bit, p) if len(key) else p
        return np.log(np.where(p >= 0, p, 0.5)).sum(1) / LOG10


def _finish(batches: Iterator[pa.RecordBatch], upper: Upper) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        run = batch.column("run").to_numpy().astype(np.uint64)
        p = np.asarray(batch.column("p").flatten(), np.float64).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("seen"), pa.array(upper.log10(run, p))], ["run", "seen", "lp"])


class Head:
    """A hash table from runs to log probabilities; the more frequent run keeps a contested slot."""

    def __init__(self, run: np.ndarray, lp: np.ndarray, seen: np.ndarray):
        order = np.argsort(run, kind="stable")
        self.run, self.lp = run[order], lp[order]
        self.bits = U(64 - max(8, int(4 * len(run)).bit_length()))
        self.slot = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        by = np.argsort(seen[order], kind="stable")  # the last write stays
        self.slot[(self.run[by] * C1) >> self.bits] = by

    def find(self, runs: np.ndarray) -> np.ndarray:
        """The position of each run in the table, -1 where it is not there."""
        if not len(self.run):
            return np.full(len(runs), -1)
        at = self.slot[(runs * C1) >> self.bits].astype(np.int64)
        lost = np.flatnonzero(self.run[at] != runs)
        again = np.searchsorted(self.run, runs[lost])
        again[again == len(self.run)] = 0
        at[lost] = np.where(self.run[again] == runs[lost], again, -1)
        return at


def _score(batches: Iterator[pa.RecordBatch], head: Head, known: dict[bytes, int], total: int, distinct: int, ends: int) -> Iterator[pa.RecordBatch]:
    norm = math.log10(total + distinct + 1) if total + distinct else 0.0
    for batch in batches:
        for piece in slices(batch, "text"):
            runs, first = byte_runs(piece.column("text"))
            at = head.find(runs)
            hit = at >= 0
            lp = np.where(hit, head.lp[np.maximum(at, 0)], 0.0) if len(head.run) else np.zeros(len(runs))
            score = np.add.reduceat(lp, first[:-1])
            miss = np.flatnonzero(~hit)
            row = np.searchsorted(first, miss, "right") - 1
            # (row, run) by row, each once.
            order = np.lexsort((runs[miss], row))
            row, rest = row[order], runs[miss][order]
            new = np.flatnonzero(np.concatenate(([True], (rest[1:] != rest[:-1]) | (row[1:] != row[:-1])))) if len(rest) else np.zeros(0, int)
            times = np.diff(np.append(new, len(rest)))
            cuts = np.searchsorted(row[new], np.arange(piece.num_rows + 1))
            n_tokens, n_known, base, tails = [], [], [], []
            for text in whole(piece.column("text")):
                own = Counter(text.as_buffer().to_pybytes().lower().split())
                n, k = sum(own.values()) + 1, 1 if ends else 0
                b = math.log10(ends + 1) - norm
                tail = []
                for w, m in own.items():
                    c = known.get(w)
                    if c is None:
                        tail.append((w, m))
                    else:
                        b += m * (math.log10(c + 1) - norm)
                        k += m if c else 0
                n_tokens.append(n)
                n_known.append(k)
                base.append(b)
                tails.append(tail)
            lists = np.concatenate(([0], np.cumsum([len(t) for t in tails])))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc"), piece.column("train"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(np.diff(first) - 1),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array([w for t in tails for w, _ in t], pa.binary())),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array([m for t in tails for _, m in t], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rest[new].astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times.astype(np.int64))),
                ],
                ["doc", "train", "n_tokens", "n_known", "base", "score", "n_bytes", "words", "word_n", "runs", "run_n"],
            )


def _head(table: DataFrame, limit: int) -> tuple[Column, int]:
    """A condition on ``seen`` that at most about ``limit`` of the most frequent rows meet."""
    sizes = table.groupBy(F.floor(F.log2("seen") * 4).cast("int").alias("step")).count().collect()
    taken, least = 0, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if taken + r["count"] > limit:
            least = r["step"] + 1
            break
        taken += r["count"]
    return F.floor(F.log2("seen") * 4).cast("int") >= least, taken


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one row per document.

    ``bits_per_byte`` is the code length of text and end symbol over the text's bytes; 0 for an empty text.
    ``train`` tells which documents the model learns from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").cast("string").alias("text"))

    words = rows.mapInArrow(_count_words, "word binary, c long, seen long")
    words = stage(words.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")), "ctw-words")
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    ends = rows.where("train").count()
    total, distinct = facts["n"] + ends, facts["v"] + (1 if ends else 0)
    often, _ = _head(words, HEAD_WORDS)
    known = dict(zip(*(c.to_pylist() for c in words.where(often).select("word", "c").toArrow().columns), strict=True))

    counted = rows.mapInArrow(_count_runs, "run long, n long, seen long")
    counted = stage(counted.groupBy("run").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "ctw-runs")
    many = partitions(counted.count(), 2 * AT_ONCE)
    group = F.shiftright("run", 8).bitwiseAND((1 << (8 * TOP)) - 1)
    schema = "run long, p array<float>, two int, node int, zeros double, ones double, weighted double"
    levels = stage(counted.select("run", "n", group.alias("top")).repartition(many, "top").select("run", "n").mapInArrow(_evaluate, schema), "ctw-levels")
    short = levels.where("run = -1 and zeros + ones > 0").groupBy("two", "node")
    short = short.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toArrow()
    upper = Shared(spark, Upper(*(short.column(c).to_numpy() for c in ("two", "node", "zeros", "ones", "weighted"))))
    table = levels.where("run >= 0").select("run", "p").join(counted.select("run", "seen"), "run").select("run", "seen", "p")
    table = stage(table.mapInArrow(lambda it: _finish(it, upper.value), "run long, seen long, lp double"), "ctw-table")
    often, _ = _head(table, HEAD_RUNS)
    top = table.where(often).toArrow()
    head = Head(top.column("run").to_numpy().astype(np.uint64), top.column("lp").to_numpy(), top.column("seen").to_numpy())
    shared = Shared(spark, (head, known))

    schema = "doc {0}, train boolean, n_tokens long, n_known long, base double, score double, n_bytes long, words array<binary>, word_n array<long>, runs array<long>, run_n array<long>"
    schema = schema.format(rows.schema["doc"].dataType.simpleString())
    done = rows.mapInArrow(lambda it: _score(it, *shared.value, total, distinct, ends), schema).withColumn("row", F.monotonically_increasing_id())
    done = stage(done, "ctw-scored")
    norm = F.lit(math.log10(total + distinct + 1) if total + distinct else 0.0)
    tail = done.select("row", F.explode(F.arrays_zip("words", "word_n")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.word_n").alias("m"))
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(words.select("word", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.col("m") * (F.log10(c + 1) - norm)).alias("base2"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known2")
    )
    rest = done.select("row", F.explode(F.arrays_zip("runs", "run_n")).alias("r")).select("row", F.col("r.runs").alias("run"), F.col("r.run_n").alias("m"))
    rest = rest.join(table.select("run", "lp"), "run").groupBy("row").agg(F.sum(F.col("m") * F.col("lp")).alias("score2"))
    out = done.drop("words", "word_n", "runs", "run_n").join(tail, "row", "left").join(rest, "row", "left")
    zero = F.lit(0.0)
    score = F.col("score") + F.coalesce("score2", zero)
    bits = F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).otherwise(zero)
    return out.select(
        F.col("doc").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), score.alias("score"),
        "n_bytes", bits.alias("bits_per_byte"),
    )
