"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.llm import conversations
from tests.conftest import SF
from tests.llm import brute

ROWS = "conv_id long, turn long, role string, text string"
ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "usher", "", None, "User", "é"]
TEXTS = ["Yes.", "No!", "no end", "", " \t\n", None, "Why? \r\n", "日本。", "日本.", "a.b", "x" * 50_000, "!"]


def odd_rows(n: int, seed: int, conversations_: int = 60) -> list[tuple]:
    pick = random.Random(seed)
    rows = [(pick.choice([None, *range(conversations_)]), pick.choice([None, *range(12), -3]), pick.choice(ROLES), pick.choice(TEXTS)) for _ in range(n)]
    rows += [(1000 + k, t, r, "Fine.") for k in range(40) for t, r in enumerate(pick.choices(["system", "user", "assistant"], k=pick.randrange(1, 9)))]
    return rows


def summaries(df, **kw) -> dict:
    got = conversations.summarize(df, **kw).collect()
    out = {r[0]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rows = odd_rows(700, seed)
    df = spark.createDataFrame(rows, ROWS)
    for c in ("conv", "kind", "initial", "gone", "pointers", "place", "again", "to_go", "time", "damage"):
        df = df.withColumn(c, F.lit("clash"))
    assert summaries(df) == brute.repaired([(*r, False) for r in rows])
    harmed = conversations.damage(df)
    assert summaries(harmed, gone=F.col("gone")) == brute.repaired(brute.damaged(rows))
    assert summaries(df.limit(0)) == {} and conversations.repair(df.limit(0)).count() == 0


def test_all_rows_gone(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, None, None, None), (2, 3, "user", "Hi.")], ROWS)
    got = summaries(df, gone=F.col("conv_id") == 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())


def test_giant_conversations(spark):
    """More rows than Arrow batches hold; among tools no two ways ever meet before the end."""
    pick = random.Random(3)
    rows = [(7, i, "tool", f"Row {i}.") for i in range(25_001)]
    rows += [(8, i, pick.choice(["user", "assistant", "tool"]), pick.choice([f"{i}.", f"{i}", "Same.", ""])) for i in range(25_000)]
    rows += [(9, 0, "user", "Again.")] * 12_000 + [(10, i, "user", "") for i in range(12_000)]
    df = spark.createDataFrame(rows, ROWS)
    assert summaries(df) == brute.repaired([(*r, False) for r in rows])


def test_string_ids(spark):
    rows = [("a", 0, "user", "Hi."), ("b", 0, "assistant", "Hi."), (None, 0, "system", "Hi."), ("", 1, "user", "Hi")]
    df = spark.createDataFrame(rows, "k string, n int, r string, x string")
    got = conversations.summarize(df, conv_col="k", turn_col="n", role_col="r", text_col="x").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.repaired([(*r, False) for r in rows])


def test_repaired_rows_are_the_digest(spark):
    rows = odd_rows(300, 5)
    df = spark.createDataFrame(rows, ROWS)
    want = summaries(df)
    edits: dict = {}
    for r in conversations.repair(df).collect():
        edits.setdefault(r["conv_id"], []).append(r)
    assert set(edits) == {c for c, s in want.items() if s[6]}
    for c, own in edits.items():
        own.sort(key=lambda r: r["number"])
        assert [r["number"] for r in own] == list(range(1, len(own) + 1))
        assert "".join(r["edit"] for r in own) == want[c][6]
        kept = [f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == want[c][7]
        assert [sum(r["fault"] == f for r in own) for f in ("blank", "duplicate", "truncated")] == list(want[c][1:4])


def test_query(spark):
    name = next(q for q in entry.queries() if q.startswith("op13_"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in entry.queries()[name](spark, SF).collect()}
    assert got == brute.repaired(brute.damaged(rows))
