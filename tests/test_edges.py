"""Extreme numbers, rates that may not be used, events that come twice, expenses without a run."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.constants import STANDARD_POLICY, STATIC_RATES
from ledgerloom.functions.numbers import parse_number, round_base, to_fixed2
from ledgerloom.operators import fx
from ledgerloom.operators.dedup import mark_duplicates
from ledgerloom.operators.paging import newest_first
from ledgerloom.plans.maintenance import detach
from ledgerloom.plans.validate import total_amount
from ledgerloom.session import new_path
from ledgerloom.sources.tables import Store
from ledgerloom.streaming.dedup_ttl import mark_first
from ledgerloom.streaming.outcomes import RecordStream


def test_every_finite_number_parses(spark):
    texts = ["1e120", "1e-150", "1" * 250, "1e400", "-1e400", "1e-400", "7" * 400, "1.5E+0003", "nan", "Infinity", "1d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_number(F.col("t")).alias("n"))
    got = [r["n"] for r in df.orderBy("i").collect()]
    assert got == [1e120, 1e-150, float("1" * 250), None, None, 0.0, None, 1500.0, None, None, None]


def test_rounding_of_large_amounts(spark):
    rows = [(1e19, "CLP"), (1e18, "USD"), (2.0**52 + 1, "CLP"), (1e300, "USD"), (-1e19, "CLP"), (10.25, "USD"), (-0.5, "CLP")]
    df = spark.createDataFrame(rows, "a double, c string").select(round_base(F.col("a"), F.col("c")).alias("r"), "a")
    assert [r["r"] for r in df.collect()] == [1e19, 1e18, 2.0**52 + 1, 1e300, -1e19, 10.3, 0.0]
    values = [1.005, 2.675, 12345678901234.567, 70000000000000.14, 9e15, -3e13 - 0.14]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", to_fixed2(F.col("v")).alias("r"))
    assert all(r["r"] == float(f"{r['v']:.2f}") for r in df.collect())
    sums = spark.createDataFrame([(0.1,)] * 10 + [(1e40,)], "v double")
    assert sums.agg(total_amount(F.col("v")).alias("t")).first()["t"] == 1e40
    assert sums.where("v < 1").agg(total_amount(F.col("v")).alias("t")).first()["t"] == 1.0


def test_rates_without_a_date_answer_any(spark):
    items = spark.createDataFrame([("a", 10.0, "CLP", "2024-01-05"), ("b", 10.0, "clp", None), ("c", 1.0, "XXX", None)], "id string, monto_original double, moneda_original string, fecha string")
    static = fx.pair_rates(fx.static_provider(STATIC_RATES, "USD")(spark))
    got = {r["id"]: (r["tipo_cambio"], r["error"]) for r in fx.convert(items, static).collect()}
    assert got == {"a": (STATIC_RATES["CLP"], None), "b": (STATIC_RATES["CLP"], None), "c": (None, fx.NO_RATE)}
    dated = spark.createDataFrame([("CLP", "USD", "2024-01-05", 0.5)], "from_ccy string, to_ccy string, date string, rate double")
    both = dated.unionByName(static, allowMissingColumns=True)
    assert {r["id"]: r["tipo_cambio"] for r in fx.convert(items, both).collect()} == {"a": 0.5, "b": STATIC_RATES["CLP"], "c": None}


def test_expired_refused_and_repeated_rates(spark):
    at = lambda h: datetime(2024, 1, 5, h)
    rates = [("A", 1.0, at(0)), ("A", 2.0, at(3)), ("B", -1.0, at(3)), ("C", float("inf"), at(3)), ("D", 0.0, at(3)), ("E", 5.0, at(3)), ("F", 6.0, datetime(2024, 1, 1))]
    table = spark.createDataFrame(rates, "from_ccy string, rate double, fetched_at timestamp").withColumns(
        {"to_ccy": F.lit("USD"), "date": F.lit("latest"), "ttl_seconds": F.lit(86400)}
    )
    items = spark.createDataFrame([(c, 1.0) for c in "ABCDEF"], "moneda_original string, monto_original double")
    got = {r["moneda_original"]: r["tipo_cambio"] for r in fx.convert(items, table, as_of=datetime(2024, 1, 5, 6)).collect()}
    assert got == {"A": 2.0, "B": None, "C": None, "D": None, "E": 5.0, "F": None}
    entries = fx.live_entries(table, spark.createDataFrame([], "date string, base string, rates map<string,double>, fetched_at timestamp, ttl_seconds int"), datetime(2024, 1, 5, 6))
    assert entries.where("from_ccy = 'F'").isEmpty() and fx.listing(entries, 2).count() == 2


def test_processes_with_one_sequence_do_not_store_twice(spark):
    rows = spark.createDataFrame([(p, 0, 1, 1, "f") for p in ("P0", "P1", "P2")], "process_id string, process_seq int, batch_index int, record_index int, fingerprint string")
    for hot in (1_000_000, 1):
        got = {r["process_id"]: r["duplicate"] for r in mark_duplicates(rows, hot_rows=hot).collect()}
        assert got == {"P0": None, "P1": "duplicate_fingerprint_db", "P2": "duplicate_fingerprint_db"}


def event(process: str, batch: int, *days: int) -> str:
    records = [
        {"gasto_id": f"{process}-{d}", "empleado_id": "E", "fecha": f"2000-12-{d:02d}", "monto": "10", "moneda": "USD", "categoria": "food", "empleado_cost_center": "x"}
        for d in days
    ]
    return json.dumps({"processId": process, "batchIndex": batch, "records": records})


def test_redelivered_batches_are_stored_once(spark):
    root = new_path(spark, "redelivery")
    store = Store(spark, f"{root}/store")
    stream = RecordStream(store, STANDARD_POLICY, STATIC_RATES, datetime(2001, 1, 1), enveloped=False)

    def wave(*lines: str):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{root}/events")
        stream.start(spark.readStream.text(f"{root}/events"), f"{root}/checkpoint", available_now=True).awaitTermination()

    wave(event("P0", 1, 1, 2), event("P0", 1, 1, 2), event("P1", 1, 2, 3))
    wave(event("P0", 1, 1, 2), event("P0", 2, 2, 4))
    rows = store.read("outcomes").select("job_id", "id", "outcome").collect()
    assert len({r["job_id"] for r in rows}) == len(rows) == 6
    assert {r["id"]: r["outcome"] for r in rows if r["id"] not in ("P0-2",)} == {
        "P0-1": "success", "P1-2": "duplicate_fingerprint_db", "P1-3": "success", "P0-4": "success",
    }
    assert sorted(r["outcome"] for r in rows if r["id"] == "P0-2") == ["duplicate_fingerprint", "success"]
    assert store.read("job_runs").count() == 6 and store.read("expenses").count() == 4
    assert store.read("job_run_stages").groupBy("job_id").count().count() == 6


def test_expiring_marks_of_no_events(spark):
    none = spark.createDataFrame([], "k string, s long, o long")
    marked, state = mark_first(none, ["k"], "o", "s", 10)
    assert marked.isEmpty() and state.columns == ["k", "expires"] and state.isEmpty()


def test_expenses_without_a_run_stay(spark):
    expenses = spark.createDataFrame([(i, None if i % 10 else f"j{i}") for i in range(100)], "id int, job_id string")
    out = detach(expenses, spark.createDataFrame([("j0",), ("j50",)], "job_id string"))
    assert out.count() == 100 and out.where("job_id is not null").count() == 8


def test_deep_pages(spark):
    rows = spark.range(3000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("job_id"),
        F.when(F.col("id") % 50 != 0, F.timestamp_micros(F.lit(978307200000000) + F.when(F.col("id") < 1500, F.floor(F.col("id") / 7) * 40_000_000).otherwise(F.lit(5)))).alias("created_at"),
    )
    want = [tuple(r) for r in rows.orderBy(F.col("created_at").desc(), "job_id").collect()]
    for offset in (0, 10, 700, 1500, 2500, 2935, 2950, 2990, 5000):
        got = [tuple(r) for r in newest_first(rows, offset, 20, shallow=5).collect()]
        assert got == want[offset : offset + 20], offset
