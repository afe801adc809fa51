"""What is computed once, and what does not move."""

from __future__ import annotations

import json
import time
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerloom.constants import STANDARD_POLICY
from ledgerloom.operators.dedup import delivered_once, first_deliveries
from ledgerloom.operators.mapping import map_columns, valid
from ledgerloom.operators.policy import literal_policy
from ledgerloom.operators.rules import evaluate
from ledgerloom.plans.reports import job_detail
from ledgerloom.session import stage
from ledgerloom.sources.events import BATCH, envelope, read_batch_events, write_batch_events
from tests.conftest import SF

COLUMNS = ["id", "empleado_id", "fecha", "monto", "moneda", "categoria", "cost_center"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_parsed_once(spark):
    rows = [("a", "e", "2000-01-01", "1,5", "USD", "food", "c"), ("b", "e", "2000-01-01", "x", "USD", "food", "c"), (" ", "e", "", "1", "USD", None, "c")]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)).repartition(2)
    fit = valid(map_columns(raw, COLUMNS))
    assert [(r.id, r.monto_original) for r in fit.collect()] == [("a", 1.5)]
    filters = [x for x in plan(fit).splitlines() if "Filter" in x]
    assert filters and not any("translate" in x for x in filters)


def test_alerts_only_where_they_are_told(spark):
    df = spark.createDataFrame([("a", 500.0), ("b", 500.0)], "id string, monto double").select(
        "id", F.lit("food").alias("categoria"), F.lit("x").alias("cost_center"), F.lit("2000-12-31").alias("fecha"), "monto"
    )
    judged = evaluate(df, literal_policy(STANDARD_POLICY), date(2001, 1, 1), amount=F.col("monto"), told=F.col("id") == "a")
    got = {r.id: (r.status, len(r.alertas)) for r in judged.collect()}
    assert got == {"a": ("RECHAZADO", 1), "b": ("RECHAZADO", 0)}
    assert "_told" not in judged.columns


def deliveries(spark, rows):
    df = spark.createDataFrame(rows, "process_id string, batch_index int, record_index int, v string")
    delivery = F.concat_ws("|", "process_id", "batch_index", F.when(F.col("process_id") == "", F.col("record_index")))
    return stage(df.withColumn("delivery", delivery), "deliveries")


def test_only_repeated_deliveries_move(spark):
    once = [("P", 1, 1, "a"), ("P", 1, 2, "b"), ("Q", 1, 1, "c"), ("", 5, 7, "d"), ("", 5, 8, "e"), (None, 1, 1, "f"), (None, 1, 2, "g")]
    got = first_deliveries(deliveries(spark, once))
    assert "Aggregate" not in plan(got) and got.count() == len(once)
    # a longer copy of one batch, a second copy of a single record, a second batch without a process
    more = [("P", 1, 1, "a"), ("P", 1, 2, "b"), ("P", 1, 3, "h"), ("", 5, 7, "d"), (None, 1, 1, "f"), ("|5", 8, 1, "i"), ("|5", 8, 2, "j")]
    rows = deliveries(spark, once + more)
    want = sorted(map(str, delivered_once(rows).collect()))
    assert sorted(map(str, first_deliveries(rows).collect())) == want and len(want) == 10


def test_envelopes_are_those_of_the_bare_events(spark, tmp_path):
    rows = [("P1", 1, 2, "b\n"), ("P1", 1, 1, "a"), ("P1", 2, 1, 'c"')]
    records = spark.createDataFrame(rows, "process_id string, batch_index int, record_index int, id string")
    write_batch_events(records, ["id"], str(tmp_path / "bare"))
    write_batch_events(records, ["id"], str(tmp_path / "enveloped"), enveloped=True)
    bare = spark.read.text(str(tmp_path / "bare")).select(envelope(BATCH, F.col("value")).alias("value"))
    full = sorted(r.value for r in spark.read.text(str(tmp_path / "enveloped")).collect())
    assert full == sorted(r.value for r in bare.collect())
    assert [x["id"] for x in json.loads(full[0])["data"]["records"]] == ["a", "b\n"]


def test_documents_are_checked_once_for_all_readers(spark):
    saved = queries()["policy_upsert"](spark, SF)
    assert "variant" not in plan(saved).lower()


def test_tenant_policies_are_parsed_before_they_meet_expenses(spark):
    counted = queries()["tenant_policies"](spark, SF)
    assert "from_json" not in plan(counted) and "variant" not in plan(counted).lower()


def test_stages_move_without_what_nobody_reads(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    stages = spark.createDataFrame(
        [("a", 0, 2, "normalize", "success", "d2"), ("a", 0, 1, "dedup", "success", "d1")],
        "job_id string, created_at int, stage_order int, stage string, status string, data string",
    )
    found = {r.job_id: r.stages for r in job_detail(runs, stages, ("stage", "status")).collect()}
    assert [tuple(s) for s in found["a"]] == [(0, 1, "dedup", "success"), (0, 2, "normalize", "success")] and found["b"] is None
    assert [s.data for s in job_detail(runs, stages).where("job_id = 'a'").first().stages] == ["d1", "d2"]
    assert "data" not in plan(queries()["job_detail_stages"](spark, SF)).split("collect_list", 1)[1].split("\n")[0]


def test_a_record_does_not_carry_its_event(spark):
    lines = spark.createDataFrame([('{"processId":"P","batchIndex":1,"records":[{"id":"a"},{"id":"b"}]}', 7)], "value string, n int")
    records = read_batch_events(lines, "n")
    assert [(r.n, r.process_id, r.batch_index, r.record_index, r.record) for r in records.collect()] == [(7, "P", 1, 1, {"id": "a"}), (7, "P", 1, 2, {"id": "b"})]
    assert "processId AS" not in plan(records).split("Generate", 1)[0]


def test_shuffles_are_gone_once_a_table_is_stored(spark):
    dirs = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in dirs for f in d.rglob("shuffle_*.data")}
    before = files()
    table = stage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(4, "k"), "counted")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 10
