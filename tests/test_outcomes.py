from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.constants import STANDARD_POLICY
from ledgerloom.operators.abort import abort_batches
from ledgerloom.operators.fx import attach_rate
from ledgerloom.operators.lookup import dimension_join, group_join, keep_where
from ledgerloom.plans import maintenance, reports
from ledgerloom.plans.audit import job_runs, job_stages, new_expenses, upsert_expenses
from ledgerloom.plans.outcomes import run_records
from ledgerloom.schemas import CANONICAL
from ledgerloom.streaming.dedup_ttl import mark_first

AS_OF = date(2001, 1, 1)
RATES = {"USD": 1.0, "CLP": 0.0012, "MXN": 0.058}


def expense(process, position, fecha="2000-12-25", monto=10.0, moneda="USD", id_=None, base=None, rate=None, batch=10):
    b, r = divmod(position, batch)
    return (f"P{process}", process, b + 1, r + 1, datetime(2001, 1, 1), id_ or f"g{process}-{position}", "e1", fecha,
            float(monto), moneda, "software", "growth", base, rate, "{}")


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, CANONICAL)
    return run_records(df, options.pop("policy", STANDARD_POLICY), options.pop("rates", RATES), AS_OF, **options)


def by_position(df):
    return {(r.process_id, (r.batch_index - 1) * 10 + r.record_index - 1): r for r in df.collect()}


def test_edges(spark):
    rows = [
        expense(0, 0, monto=10), expense(0, 1, monto=10), expense(0, 2, monto=-10), expense(0, 3, monto=-10),
        expense(0, 4, monto=0), expense(0, 5, monto=10, moneda="CLP"), expense(0, 6, fecha="2000-02-30"),
        expense(0, 7, moneda="EUR"), expense(0, 8, moneda="MXN", monto=5, rate=2.0), expense(0, 9, moneda="usd", monto=10),
        expense(0, 10, moneda="EUR", monto=4, base=12.34), expense(1, 0, monto=10), expense(1, 1, monto=-10),
    ]
    got = by_position(run(spark, rows))
    want = ["success", "duplicate_fingerprint", "negative_amount", "duplicate_fingerprint", "failed", "failed", "failed", "failed",
            "success", "success", "success"]
    assert [got[("P0", i)].outcome for i in range(11)] == want
    assert got[("P1", 0)].outcome == "duplicate_fingerprint_db" and got[("P1", 1)].outcome == "negative_amount"
    assert (got[("P0", 8)].exchange_rate, got[("P0", 8)].base_amount) == (2.0, 0.3)
    assert (got[("P0", 10)].base_amount, got[("P0", 10)].exchange_rate) == (12.3, 12.3 / 4)
    assert [got[("P0", i)].failed_stage for i in (4, 5, 6, 7)] == ["validation", "validation", "validation", "currency"]
    assert "yyyy" not in got[("P0", 6)].error and "Fecha de gasto inválida" in got[("P0", 6)].error


def test_base_rounding(spark):
    clp = {**STANDARD_POLICY, "moneda_base": "CLP"}
    rows = [expense(0, 0, base=1234.56), expense(0, 1, monto=11)]
    got = by_position(run(spark, rows, policy=clp, rates={"USD": 9.87}))
    assert (got[("P0", 0)].base_amount, got[("P0", 1)].base_amount) == (1235.0, 109.0)


def brute(rows):
    """One record after the other, as a single worker would."""
    out, stored = {}, set()
    seen = set()
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        key = (r[7], r[8], r[9])
        if (r[0], key) in seen:
            out[r[0], r[2], r[3]] = "duplicate_fingerprint"
        elif key in stored:
            out[r[0], r[2], r[3]] = "duplicate_fingerprint_db"
        else:
            seen.add((r[0], key))
            if r[8] < 0:
                out[r[0], r[2], r[3]] = "negative_amount"
            elif r[8] == 0 or (r[9] == "EUR" and r[12] is None):
                out[r[0], r[2], r[3]] = "failed"
            else:
                out[r[0], r[2], r[3]] = "success"
                stored.add(key)
    return out


@pytest.mark.parametrize("hot_rows", [1, 5, 1_000_000])
def test_against_one_worker(spark, hot_rows):
    rnd = random.Random(hot_rows)
    rows = []
    for p in range(4):
        for i in range(120):
            hot = rnd.random() < 0.35
            monto = 7 if hot else rnd.choice([-2, 0, 1, 2, 3, 4, 5])
            moneda = "USD" if hot else rnd.choice(["USD", "EUR", "MXN"])
            rows.append(expense(p, i, f"2000-12-{25 if hot else rnd.randint(10, 12)}", monto, moneda,
                                base=3.0 if moneda == "EUR" and rnd.random() < 0.3 else None))
    rnd.shuffle(rows)
    got = {(r.process_id, r.batch_index, r.record_index): r.outcome for r in run(spark, rows, hot_rows=hot_rows).collect()}
    assert got == brute(rows)


def test_tables_and_rerun(spark):
    rows = [expense(0, i, monto=i % 4 + 1, id_=f"g{i % 3}") for i in range(8)] + [expense(0, 8, monto=-1)]
    outcomes = run(spark, rows).cache()
    runs, stages, stored = job_runs(outcomes, STANDARD_POLICY), job_stages(outcomes), new_expenses(outcomes)
    assert runs.count() == 9 and stages.count() == 4 * 5 + 4 + 2
    # ids g0, g1, g2 were written by positions 3, 1 and 2
    assert sorted((r.id, r.monto_original) for r in stored.collect()) == [("g0", 4.0), ("g1", 2.0), ("g2", 3.0)]
    again = run(spark, rows, persisted=stored)
    assert {r.outcome for r in again.where("monto_original between 2 and 4").collect()} == {"duplicate_fingerprint_db"}
    assert upsert_expenses(stored, outcomes).count() == 3
    seen = outcomes.select("process_id", "fingerprint")
    assert {r.outcome for r in run(spark, rows, seen=seen).collect()} == {"duplicate_fingerprint"}
    metrics = reports.process_metrics(runs, stored).first()
    assert (metrics.processed_records, metrics.skipped_records, metrics.negative_records, metrics.duplicate_records) == (4, 5, 1, 4)
    assert reports.process_audit(runs, stored, "P0", "negative").count() == 1
    with pytest.raises(ValueError):
        reports.process_audit(runs, stored, "P0", "other")
    with pytest.raises(ValueError):
        reports.filter_runs(runs, status="odd")
    info = reports.page_info(runs, page=99, page_size=4).first()
    assert (info.page, info.total_pages, info.has_next, info.has_previous) == (3, 3, False, True)


def test_deletions(spark):
    outcomes = run(spark, [expense(0, 0, id_="a"), expense(0, 1, monto=3, id_="b"), expense(1, 0, monto=4, id_="a")]).cache()
    batches = spark.createDataFrame([("P0", 1, ["a", "b"]), ("P1", 1, ["a"])], "process_id string, batch_index int, expense_ids array<string>")
    processes = spark.createDataFrame([("P0",), ("P1",)], "process_id string")
    tables = maintenance.Tables(job_runs(outcomes), job_stages(outcomes), new_expenses(outcomes), batches, processes)
    soft = maintenance.delete_process(tables, "P0")
    assert {(r.id, r.job_id is None) for r in soft.expenses.collect()} == {("a", False), ("b", True)}
    assert (soft.runs.count(), soft.batches.count(), soft.processes.count()) == (1, 1, 1)
    assert maintenance.delete_process(tables, "P0", hard=True).expenses.count() == 0
    scoped = maintenance.delete_process(tables, "P0", hard=True, strict_scope=True)
    assert [r.id for r in scoped.expenses.collect()] == ["a"]
    after, removed = maintenance.delete_jobs(tables, tables.runs.where("expense_id = 'b'"))
    assert removed.first().deleted == 1 and after.runs.count() == 2 and after.expenses.where("job_id is null").count() == 1


def test_abort_against_one_worker(spark):
    rnd = random.Random(5)
    rows = [(f"P{p}", b, r, f"f{rnd.randint(0, 40)}") for p in range(2) for b in range(1, 9) for r in range(1, 11)]
    rows = [(*r, rnd.random() < 0.15) for r in rows]
    want, seen = {}, set()
    for p, b, r, f, error in rows:
        if (p, b) in want or (p, f) in seen:
            continue
        seen.add((p, f))
        if error:
            want[p, b] = r
    df = spark.createDataFrame(rows, "process_id string, batch_index int, record_index int, fingerprint string, error boolean")
    assert {(r.process_id, r.batch_index): r.first_error for r in abort_batches(df).collect()} == want


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_ttl_against_one_worker(spark, hot_rows):
    rnd = random.Random(3)
    events = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 400) * 1_000_000) for i in range(200)]
    events.sort(key=lambda e: (e[2], e[0]))
    want, expires = {}, {}
    for i, k, t in events:
        new = k not in expires or t >= expires[k]
        want[i] = "first" if new else "skipped"
        if new:
            expires[k] = t + 60_000_000
    state, got = None, {}
    for part in (events[:90], events[90:]):
        df = spark.createDataFrame(part, "event_id long, k string, t long")
        marked, state = mark_first(df, ["k"], "event_id", "t", 60, state, hot_rows)
        got.update({r.event_id: r.mark for r in marked.collect()})
    assert got == want
    assert {r.k: r.expires for r in state.collect()} == expires


def test_balanced_joins(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    dim = rows.select("k").distinct().withColumn("v", F.length("k"))
    for limit in (0, 1000):
        joined = dimension_join(rows, dim, ["k"], [F.col("id")], limit=limit, salts=5)
        assert joined.count() == 300 and joined.where("v != length(k)").count() == 0
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    joined = group_join(rows, groups, ["k"], "n", F.col("id") + 1, hot_rows=50)
    assert joined.count() == 300 and joined.where("lo is null or n is null").count() == 0
    assert keep_where(rows, F.col("k") == "hot").count() == 200


def test_dated_rates(spark):
    pairs = spark.createDataFrame([("EUR", "USD", "2000-01-01", 1.1), ("EUR", "USD", "latest", 1.2)], "from_ccy string, to_ccy string, date string, rate double")
    df = spark.createDataFrame([("eur", "2000-01-01"), ("EUR", None), ("EUR", "1999-01-01"), ("USD", "1999-01-01")], "m string, fecha string")
    got = [r.rate for r in attach_rate(df, pairs, F.col("m"), F.lit("usd"), F.col("fecha")).collect()]
    assert got == [1.1, 1.2, None, 1.0]


def test_raw_rows_travel_and_are_parsed_on_both_sides(spark):
    """Invalid rows, duplicates and stored prints come out as if the parsed rows had travelled."""
    from ledgerloom.operators.mapping import LINEAGE, map_columns, valid

    columns = ["gasto_id", "employee", "date", "monto", "moneda", "category", "costcenter"]
    cells = [("1", "10"), ("2", "10,0"), ("3", "-4"), ("4", ""), ("5", "7"), ("6", "5"), ("7", "7")]
    raw = spark.createDataFrame(
        [("p", 0, 1, i + 1, x, "E1", "2024-01-05", m, "USD", "food", "c", "left behind") for i, (x, m) in enumerate(cells)],
        ["process_id", "process_seq", "batch_index", "record_index", *columns, "other"],
    )

    def parse(rows, keep):
        return valid(map_columns(rows, columns, keep=[c for c in keep if c not in LINEAGE]))

    def rows(df):
        return sorted(map(str, df.drop("created_at").collect()))

    plain = run_records(parse(raw, []), STANDARD_POLICY, RATES, AS_OF)
    known = plain.where("id = '6'").select("fingerprint").unionByName(spark.createDataFrame([("no digits",), (None,)], "fingerprint string"))
    want = run_records(parse(raw, []), STANDARD_POLICY, RATES, AS_OF, persisted=known)
    got = run_records(raw, STANDARD_POLICY, RATES, AS_OF, persisted=known, parse=parse)
    assert rows(got) == rows(want) and got.columns == want.columns
    outcome = {r["id"]: r["outcome"] for r in got.collect()}
    assert outcome == {"1": "success", "2": "duplicate_fingerprint", "3": "negative_amount", "5": "success", "6": "duplicate_fingerprint_db", "7": "duplicate_fingerprint"}
    assert got.where(F.length("fingerprint") == 64).count() == 6


def test_packed_outcomes_hold_bytes(spark):
    from ledgerloom.functions.identity import job_id
    from ledgerloom.plans.outcomes import packed, unpacked

    rows = spark.createDataFrame([("p", 1, 2, "ab" * 32), ("", 3, 4, None)], "process_id string, batch_index int, record_index int, fingerprint string")
    whole = rows.withColumn("job_id", job_id(F.col("process_id"), F.col("batch_index"), F.col("record_index")))
    small = packed(whole)
    assert dict(small.dtypes)["fingerprint"] == "binary" and "job_id" not in small.columns
    assert sorted(map(str, unpacked(small).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
