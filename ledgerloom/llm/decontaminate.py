"""Benchmark decontamination (operator 10): rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased. Every
run of ``SEED`` words of a test item is a seed (an item with fewer words is one seed). One scan counts in how many documents each
seed stands; an item's rare seeds are those in at most a share ``RARE`` of the documents, or not much more frequent than the
median of its seeds that occur. A second scan finds all seeds, puts hits on near diagonals of one item
together, and aligns the passage around them with the item word by word: +2 for a match, -1 for
a substitution, insertion or deletion. A passage with frequent seeds only is aligned if it holds as many of the item's words as
``MIN_SCORE`` needs at least, so a much copied or much edited item is found too. ``score`` is the best alignment over the best
possible one; a text matches from ``MIN_SCORE`` on, or if it holds ``MIN_RUN`` words of an item in a row, however long the
item (``score`` and place are then those of the best alignment near such a run). Both scans read whole texts and move only counts.

Items are the query set: they are taken in blocks of bounded size, each sent to all tasks. Items that
are null, without words or repeated: the first two match nothing, repeated ids are all tried. Null or empty
documents match nothing. All columns of the documents are kept; a column named ``matches`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.share import Shared
from ledgerloom.llm.text import U, flat, mix, runs, slices, word_hashes, words

SEED = 3
RARE = 0.001  # share of the documents up to which a seed is rare
TIMES_MEDIAN = 4
MIN_SCORE = 0.55
MIN_RUN = 13  # words of an item in a row that match without that score
BLOCK_BYTES = 8 << 20  # text of the items sent at once

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False

MATCHES = T.ArrayType(
    T.StructType()
    .add("item_id", T.LongType()).add("score", T.DoubleType()).add("matched", T.LongType())
    .add("first_word", T.LongType()).add("last_word", T.LongType())
)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of b's words in a, and the run of a's words it covers (first, last)."""
    best, last = _best_end(a, b)
    if not best:
        return 0, -1, -1
    _, back = _best_end(a[last::-1], b[::-1], best)
    return best, last - back, last


def _best_end(a: np.ndarray, b: np.ndarray, goal: int | None = None) -> tuple[int, int]:
    steps = np.arange(len(a) + 1)
    row = np.zeros(len(a) + 1, np.int64)
    best, at = 0, -1
    for word in b:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(a == word, 2, -1))
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top - 1
            if best == goal:
                break
    return best, at


class Items:
    """A block of test items with the seeds looked for."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = flat(pa.array(texts, pa.large_string()))
        start, end, first = words(data, offsets, NOT_WORD)
        hashes = word_hashes(data, start, end)
        self.ids = ids
        self.words = [hashes[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)]
        seeds, item, at = [], [], []
        for i, own in enumerate(self.words):
            n = min(SEED, len(own))
            if n:
                found = seed_runs(own, n)
                seeds.append(found)
                item += [i] * len(found)
                at += range(len(found))
        seeds = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(seeds, kind="stable")
        self.seed, self.item, self.at = seeds[order], np.array(item, np.int64)[order], np.array(at, np.int64)[order]
        self.lengths = sorted({min(SEED, len(w)) for w in self.words} - {0})
        self.rare = np.ones(len(self.seed), bool)
        self.distinct, self.begin = np.unique(self.seed, return_index=True)
        self.begin = np.append(self.begin, len(self.seed))
        self.screen = np.zeros(1 << 16, bool)
        self.screen[(self.distinct >> U(48)).astype(np.int64)] = True

    def mark_rare(self, df: np.ndarray, docs: int) -> None:
        """``df``: documents per distinct seed."""
        own = df[np.searchsorted(self.distinct, self.seed)]
        seen = np.flatnonzero(own)
        order = seen[np.lexsort((own[seen], self.item[seen]))]
        size = np.bincount(self.item[seen], minlength=len(self.ids))
        middle = np.cumsum(size) - size + np.maximum(size - 1, 0) // 2
        median = np.zeros(len(self.ids), np.int64)
        median[size > 0] = own[order[middle[size > 0]]]
        self.rare = own <= np.maximum(RARE * docs, TIMES_MEDIAN * median[self.item])

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, distinct seed) of the seeds in a piece, by row and word."""
        found = []
        for n in self.lengths:
            grams = seed_runs(hashes, n)
            word = np.flatnonzero(self.screen[(grams >> U(48)).astype(np.int64)])
            at = np.searchsorted(self.distinct, grams[word])
            at[at == len(self.distinct)] = 0
            ok = self.distinct[at] == grams[word]
            word, at = word[ok], at[ok]
            row = np.searchsorted(first, word, "right") - 1
            ok = word + n <= first[row + 1]
            found.append((row[ok], word[ok], at[ok]))
        row, word, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((word, row))
        return row[order], word[order], at[order]


def seed_runs(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix(runs(hashes, n) + U(n))


def _prepared(piece: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(piece.column(text))
    start, end, first = words(data, offsets, NOT_WORD)
    return word_hashes(data, start, end), first


def _count(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(len(items.distinct), np.int64), 0
    for batch in batches:
        for piece in slices(batch, "text"):
            hashes, first = _prepared(piece, "text")
            docs += piece.num_rows
            if items.lengths:
                row, _, at = items.hits(hashes, first)
                df += np.bincount(np.unique(row * len(df) + at) % len(df), minlength=len(df))
    seen = np.flatnonzero(df)
    seed, n = np.append(seen, -1), np.append(df[seen], docs)
    yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(n)], ["seed", "n"])


def longest(hits: list[tuple[int, int, bool]]) -> int:
    """The most hits in a row: on one diagonal at successive words. Hits are sorted."""
    most = run = 1
    for (d0, w0, _), (d1, w1, _) in pairwise(hits):
        run = run + 1 if d0 == d1 and w1 == w0 + 1 else 1
        most = max(most, run)
    return most


def _matches(hashes: np.ndarray, lo: int, hi: int, word: np.ndarray, at: np.ndarray, items: Items) -> list[dict]:
    """One document's items: hits, their diagonals, and the alignment around each."""
    spots: dict[int, list[tuple[int, int, bool]]] = {}
    for w, s in zip(word.tolist(), at.tolist(), strict=True):
        for k in range(items.begin[s], items.begin[s + 1]):
            spots.setdefault(int(items.item[k]), []).append((w - int(items.at[k]), w, bool(items.rare[k])))
    out = []
    for i, found in spots.items():
        own = items.words[i]
        found.sort()
        best = (0, -1, -1)
        begin = 0
        for k in range(1, len(found) + 1):
            if k == len(found) or found[k][0] - found[k - 1][0] > len(own):
                near = found[begin:k]
                left = max(lo, near[0][0] - len(own))
                right = min(hi, near[-1][0] + 2 * len(own))
                long = longest(near) + SEED - 1 >= MIN_RUN
                if long or any(rare for *_, rare in near) or np.isin(own, hashes[left:right]).sum() / len(own) >= MIN_SCORE:
                    score, a, b = align(hashes[left:right], own)
                    if long or score / (2 * len(own)) >= MIN_SCORE:
                        best = max(best, (score, left + a - lo, left + b - lo), key=lambda x: x[0])
                begin = k
        if best[0]:
            score = best[0] / (2 * len(own))
            held = np.isin(own, hashes[lo + best[1] : lo + best[2] + 1]).sum()
            out.append({"item_id": items.ids[i], "score": score, "matched": int(held), "first_word": best[1], "last_word": best[2]})
    return sorted(out, key=lambda m: m["item_id"])


def _find(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    for batch in batches:
        for piece in slices(batch, "_text"):
            hashes, first = _prepared(piece, "_text")
            found: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            if items.lengths:
                row, word, at = items.hits(hashes, first)
                cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
                for r in np.unique(row):
                    span = slice(cuts[r], cuts[r + 1])
                    found[r] = _matches(hashes, first[r], first[r + 1], word[span], at[span], items)
            own = [(n, c) for n, c in zip(piece.schema.names, piece.columns, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in own], pa.array(found, kind)], [*[n for n, _ in own], "_found"])


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of about BLOCK_BYTES of text, one at a time on the driver."""
    rows = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        yield [r["id"] for r in part], [r["text"] for r in part]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with ``matches``: the test items found in each text, with score and place in words."""
    spark, names = docs.sparkSession, docs.columns
    text = F.col(f"`{text_col}`").cast("string")
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).withColumn("_all", F.array().cast(MATCHES))
    at = f"c{names.index(text_col)}"
    for ids, texts in item_blocks(benchmark, item_col, item_text_col):
        block = Items(ids, texts)
        first = Shared(spark, block)
        counts = docs.select(text.alias("text")).mapInArrow(lambda it, b=first: _count(it, b.value), "seed long, n long")
        df = np.zeros(len(block.distinct), np.int64)
        total = 0
        for r in counts.groupBy("seed").agg(F.sum("n").alias("n")).collect():
            if r["seed"] < 0:
                total = r["n"]
            else:
                df[r["seed"]] = r["n"]
        block.mark_rare(df, total)
        second = Shared(spark, block)
        rows = out.withColumn("_text", F.col(at).cast("string"))
        kind = T.StructType([f for f in rows.schema.fields if f.name != "_text"]).add("_found", MATCHES)
        out = rows.mapInArrow(lambda it, b=second: _find(it, b.value), kind).withColumn("_all", F.concat("_all", "_found")).drop("_found")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != "matches"]
    return out.select(*kept, F.col("_all").alias("matches"))


def matched_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, matched, first_word, last_word), one row per document and item found in it."""
    found = contaminated(docs.select(id_col, text_col), benchmark, id_col, text_col)
    rows = found.select(F.col(id_col).alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")
    best = F.max(F.struct("score", "matched", (-F.col("first_word")).alias("f"), "last_word")).alias("m")
    return rows.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.score", "m.matched", (-F.col("m.f")).alias("first_word"), "m.last_word"
    )
