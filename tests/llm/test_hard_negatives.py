"""Hard-negative mining against a full comparison."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.llm import hard_negatives
from tests.conftest import SF
from tests.llm import brute

VECTORS = "vec_id long, embedding array<double>, label int"


def mined(df, **kw) -> set[tuple]:
    rows = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def wanted(df, **kw) -> set[tuple]:
    rows = [(r["vec_id"], r["label"], r["embedding"], r["vec_id"] is not None and r["vec_id"] % 10 == 0) for r in df.collect()]
    return brute.hard_negatives(rows, **kw)


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, repeats, nulls, non-finite and empty vectors, two dimensions, scores of every sign, clashing columns."""
    pick = random.Random(3)
    rows = [(i, [pick.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)], i % 3) for i in range(120)]
    rows += [(200 + i, [pick.random(), 1.0], i % 2) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, [nan, 1.0], 0), (301, [inf, 1.0], 1), (302, [None, 1.0], 0), (303, None, 0), (310, [1.0, 1.0], None), (None, [1.0, 1.0], 0), (320, [], 0), (321, [], 0), (322, [], 1)]
    rows += [rows[0], rows[10], rows[10], (20, [1.0, 1.0, 1.0], 2), (20, [0.25, 1.0, 1.0], 1), (31, [0.25, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "anchor", "fall", "kind", "dim", "vector", "is_anchor", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_odd_rows(odd):
    want = wanted(odd)
    assert len(want) > 300 and {r[4] for r in want} & {0}  # zero scores open a window of zeros
    assert mined(odd) == want
    assert mined(odd, positives=1, negatives=2, low=0, high=100) == wanted(odd, positives=1, negatives=2, low=0, high=100)
    assert mined(odd.limit(0)) == set()
    assert mined(odd.where("vec_id % 10 <> 0")) == set()


def test_small_chunks_tiles_and_merges(odd, monkeypatch):
    want = wanted(odd)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    monkeypatch.setattr(hard_negatives, "TILE", 7)
    monkeypatch.setattr(hard_negatives, "PENDING", 3)
    assert mined(odd.coalesce(2)) == want


def test_large_components(spark):
    pick = random.Random(4)
    rows = [(i, [pick.uniform(-1, 1) * 10.0 ** pick.choice([0, 8, 14]) for _ in range(4)], i % 2) for i in range(40)]
    rows += [(50, [1e305, -1e305, 0.0, 1.0], 0), (51, [1e305, 1.0, 0.0, 1.0], 1), (60, [1e16, 3.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df) == wanted(df)


def test_query(spark):
    name = next(q for q in entry.queries() if q.startswith("op11_"))
    got = entry.queries()[name](spark, SF)
    assert got.schema["rank"].dataType.simpleString() == "int"
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        i, label = r["vec_id"], r["label"]
        rows.append((i, (label + 1) % 10 if label is not None and i % 7 == 0 else label, r["embedding"], i % 100 == 0))
    assert {tuple(r) for r in got.collect()} == brute.hard_negatives(rows)


def test_first_keeps_the_first():
    rng = np.random.default_rng(2)
    first = hard_negatives.First(4, 3)
    seen = []
    for _ in range(50):
        slot, score, ids = rng.integers(0, 4, 20), rng.integers(0, 9, 20), rng.integers(0, 30, 20)
        first.add(slot, score, ids)
        seen += list(zip(slot.tolist(), score.tolist(), ids.tolist(), strict=True))
    want = [x for s in range(4) for x in sorted({x for x in seen if x[0] == s}, key=lambda x: (-x[1], x[2]))[:3]]
    assert list(zip(*(v.tolist() for v in first.merge()), strict=True)) == want
