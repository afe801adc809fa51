from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import DataFrameWriter, Window
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.constants import STANDARD_POLICY, STATIC_RATES
from ledgerloom.functions.identity import job_id
from ledgerloom.operators import numbering
from ledgerloom.operators.lookup import dimension_join, is_small
from ledgerloom.operators.mapping import map_columns, map_records, quarantined, valid, valid_records
from ledgerloom.operators.numbering import number_in_order, running_sum
from ledgerloom.operators.upsert import last_per_key, upsert_policies
from ledgerloom.plans import stored
from ledgerloom.plans.audit import job_runs, job_stages
from ledgerloom.plans.ingest import ingest_files, ingest_into, progress
from ledgerloom.plans.outcomes import run_records
from ledgerloom.plans.reports import list_processes
from ledgerloom.session import stage, staging
from ledgerloom.sources.events import bad_envelopes, known_patterns, read_batch_events, read_record_events
from ledgerloom.sources.files import read_expense_csv, unique_names
from ledgerloom.sources.tables import FAN, Changed, Store

HEADER = "gasto_id,empleado_id, FECHA ,Monto,moneda,categoria,empleado_cost_center"


def line(i):
    return f'g{i},e{i},2000-12-{i % 28 + 1:02d},"{i},5",USD,food,"a, ""b"""'


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *[line(i) for i in range(23)], "", ""]))
    (tmp_path / "b.CSV").write_text("\n".join([HEADER, *[line(i) for i in range(5)], "only,three,cells"]))
    (tmp_path / "c.txt").write_text("not,taken\n1,2\n")
    done = ingest_files(spark, str(tmp_path), 10)
    files = {r.filename: r for r in done.processes.collect()}
    assert (files["a.csv"].status, files["a.csv"].total_records, files["a.csv"].published_batches) == ("COMPLETADO", 23, 3)
    assert files["b.CSV"].status == "ERROR" and files["b.CSV"].total_records == 0
    rows = done.records.orderBy("seq").collect()
    assert [r.gasto_id for r in rows] == [f"g{i}" for i in range(23)]
    sizes = [(r.batch_index, r.record_count, len(r.expense_ids)) for r in done.batches.orderBy("batch_index").collect()]
    assert sizes == [(1, 10, 10), (2, 10, 10), (3, 3, 3)]
    assert [r.total_records for r in progress(done.batches).orderBy("batch_index").collect()] == [10, 20, 23]
    first = valid(map_columns(done.records, done.columns)).orderBy("batch_index", "record_index").first()
    assert (first.id, first.monto_original, first.cost_center) == ("g0", 0.5, 'a, "b"')
    loose = ingest_files(spark, str(tmp_path), 10, strict=False)
    assert {r.filename: r.total_records for r in loose.processes.collect()} == {"a.csv": 23, "b.CSV": 5}
    with pytest.raises(Exception):
        read_expense_csv(spark, str(tmp_path), mode="FAILFAST")[0].collect()
    with pytest.raises(ValueError):
        ingest_files(spark, str(tmp_path), 0)


def test_file_order_over_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("\n".join(["id,monto", *[f"i{i},{i}" for i in range(20000)]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ingest_files(spark, str(tmp_path), 500).records
        assert rows.where(F.col("id") != F.concat(F.lit("i"), F.col("seq") - 1)).count() == 0
        assert rows.agg(F.max("seq"), F.count("*")).first()[:] == (20000, 20000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers(spark):
    assert unique_names(["Monto", "x", "MONTO"]) == ["_shadowed_0", "x", "MONTO"]
    df = spark.createDataFrame([("", "g1", "e", "2000-01-01", "5", "USD", "food", "c")], "id string, gasto_id string, employee string, date string, amount string, currency string, category string, costcenter string")
    bad = quarantined(map_columns(df, df.columns), df.columns).first()
    assert bad.missing == ["id"] and bad.error.startswith("Registro inválido: faltan campos requeridos (id). Columnas recibidas: id, gasto_id")


def test_records(spark):
    event = {"processId": "P", "batchIndex": 2, "records": [
        {" Monto ": "1", "MONTO": "2,5", "id": "a", "empleado": "e", "fecha": "f", "moneda": "m", "category": "c", "costcenter": "x"},
        {"id": "b", "amount": 7, "empleado": None, "employee": "e", "fecha": "f", "moneda": "m", "category": "c", "costcenter": "x"},
        {"id": ""}]}
    lines = spark.createDataFrame([(json.dumps(event),), ('{"processId":"P","records":{"a":1}}',), ("oops",)], "value string")
    rows = read_batch_events(lines)
    assert rows.count() == 3
    good = valid_records(map_records(rows)).orderBy("record_index").collect()
    assert [(r.id, r.monto_original, r.empleado_id, r.record_index) for r in good] == [("a", 2.5, "e", 1), ("b", 7.0, "e", 2)]
    one = read_record_events(spark.createDataFrame([('{"id":"z","monto_original":3}',)], "value string")).first()
    assert one.process_id == "" and one.record["id"] == "z"
    envelopes = spark.createDataFrame([('{"pattern":"expense.batch","data":{}}',), ('{"pattern":"odd","data":1}',), ("{}",), ("x",)], "value string")
    assert (known_patterns(envelopes).count(), bad_envelopes(envelopes).count()) == (1, 2)


def test_numbering(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.xxhash64("id").alias("o"))
    numbered = number_in_order(df, "g", ["o"])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert numbered.join(want, ["g", "o"]).where("seq != want").count() == 0 and numbered.count() == 5000
    small = spark.range(1, 101).select(F.lit("p").alias("p"), F.col("id").cast("int").alias("n"), (F.col("id") % 7).alias("v"))
    total, want = 0, {}
    for i in range(1, 101):
        total += i % 7
        want[i] = total
    assert {r.n: r.running_v for r in running_sum(small, "p", "n", ["v"], chunk=8).collect()} == want


def test_keyed_writes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "id string, n int")
    last = last_per_key(df, "id", [F.col("n").desc()])
    assert {(r.id, r.n) for r in last.collect()} == {("a", 3), ("b", 2)}
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()
    store = Store(spark, str(tmp_path))
    assert not store.exists("expenses")
    store.write("expenses", df)
    store.write("expenses", store.read("expenses").where("n > 1"))
    assert store.read("expenses").count() == 2
    store.write("job_runs", df.withColumn("process_id", F.col("id")))
    assert store.read("job_runs").where("process_id = 'a'").count() == 2
    at = lambda s: F.lit(s).cast("timestamp")
    old = spark.range(1).select(F.lit("current").alias("name"), F.lit("{}").alias("policies"), at("2000-01-01").alias("created_at"), at("2000-01-01").alias("updated_at"))
    new = spark.createDataFrame([("current", "{1}"), ("t", "{2}")], "name string, policies string")
    saved = {r.name: (r.policies, r.created_at.year, r.updated_at.year) for r in upsert_policies(old, new, at("2001-01-01")).collect()}
    assert saved == {"current": ("{1}", 2000, 2001), "t": ("{2}", 2001, 2001)}


def files_of(store) -> dict[str, set[str]]:
    """table -> the files in force."""
    return {n: set(store.read(n).inputFiles()) for n in store.manifest()["tables"]}


def test_commits_touch_only_their_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ids = spark.range(200).select(F.concat(F.lit("e"), F.col("id")).alias("id"), F.concat(F.lit("P/"), F.pmod("id", F.lit(4))).alias("process_id"))
    with store.commit(stream=3) as c:
        c.append("expenses", ids.select("id", F.concat(F.lit("j"), "id").alias("job_id"), F.lit(1).alias("n")))
        c.append("job_runs", ids.select(F.concat(F.lit("j"), "id").alias("job_id"), F.col("id").alias("expense_id"), "process_id"))
        c.append("job_run_stages", ids.select(F.concat(F.lit("j"), "id").alias("job_id"), "process_id"))
        c.append("file_process_batches", ids.groupBy("process_id").agg(F.collect_list("id").alias("expense_ids")))
        c.append("file_processes", ids.select("process_id").distinct())
    before = files_of(store)
    assert store.mark("stream") == 3 and store.read("job_runs", ["P/1"]).count() == 50 and store.read("job_runs", ["none"]).count() == 0

    removed = stored.delete_jobs(store, spark.createDataFrame([("je1", "P/1"), ("je5", "P/1"), ("none", "P/1")], "job_id string, process_id string"))
    assert removed == 2 and store.mark("stream") == 3
    after = files_of(store)
    assert store.read("expenses").where("job_id is null").count() == 2 and store.read("expenses").count() == 200
    assert len(before["expenses"] - after["expenses"]) <= 2 and before["file_processes"] == after["file_processes"]
    for name in ("job_runs", "job_run_stages"):
        assert store.read(name).count() == 198
        assert all("P%252F1" in f for f in before[name] ^ after[name])

    for hard in (False, True):
        before = files_of(store)
        process = "P/2" if hard else "P/3"
        stored.delete_process(store, process, hard=hard)
        after = files_of(store)
        for name in ("job_runs", "job_run_stages", "file_process_batches"):
            assert not after[name] - before[name] and before[name] - after[name]
            assert all(process.replace("/", "%252F") in f for f in before[name] - after[name])
            assert store.read(name).where(F.col("process_id") == process).count() == 0
    assert store.read("expenses").count() == 150 and store.read("expenses").where("job_id is null").count() == 52
    assert {r.process_id for r in store.read("file_processes").collect()} == {"P/0", "P/1"}

    def upsert(rows):
        with store.commit() as c:
            c.amend("expenses", rows, "id", add=rows)

    before = files_of(store)
    upsert(spark.createDataFrame([("e0", "new", 7)], "id string, job_id string, n int"))
    after = files_of(store)
    assert {(r.job_id, r.n) for r in store.read("expenses").where("id = 'e0'").collect()} == {("new", 7)}
    assert len(after["expenses"] - before["expenses"]) == 1 == len(before["expenses"] - after["expenses"])
    upsert(spark.createDataFrame([("unseen", "new", 7)], "id string, job_id string, n int"))
    assert not after["expenses"] - files_of(store)["expenses"] and store.read("expenses").count() == 151


def test_a_commit_is_whole_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("job_runs", spark.createDataFrame([("a", "p")], "job_id string, process_id string"))
    with pytest.raises(ZeroDivisionError), store.commit() as c:
        c.append("job_runs", spark.createDataFrame([("b", "p")], "job_id string, process_id string"))
        raise ZeroDivisionError
    assert store.read("job_runs").count() == 1 and len(store.files.names("data")) == 1
    with pytest.raises(Changed), store.commit() as late:
        late.append("job_runs", spark.createDataFrame([("c", "p")], "job_id string, process_id string"))
        store.write("other", spark.range(3))
    assert store.read("job_runs").count() == 1 and store.read("other").count() == 3
    for n in range(4):
        store.write("other", spark.range(n))
    assert store.read("other").count() == 3 and store.read("other", at=4).count() == 1
    store.vacuum(keep=2)
    assert len(store.versions()) == 2 and len(store.files.names("data")) == 3
    assert store.read("other").count() == 3 and store.read("job_runs").count() == 1
    store.write("empty", spark.range(0))
    assert store.read("empty").count() == 0 and store.read("empty").columns == ["id"]


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('gasto_id,empleado_id,fecha,monto,moneda,categoria,empleado_cost_center\ng1,e1,2000-12-01,"1,5",USD,food,"a\nb"\ng2,e2,2000-12-02,,USD,food,c\n')
    (tmp_path / "b.csv").write_text("moneda , AMOUNT,id,date,employee,Category,costcenter\nCLP,4,h1,2000-12-03,e3,food,d\n")
    (tmp_path / "c.csv").write_text('﻿"id","Monto","fecha","moneda","empleado_id","categoria","cost_center","nota"\n"k1","7","2000-12-04","EUR","e4","food","x","n"\n')
    (tmp_path / "d.csv").write_text("id,monto\nbroken\n")
    store = Store(spark, str(tmp_path / "store"))
    rows = {r.id: r for r in ingest_into(store, f"{tmp_path}/*.csv", 10).collect()}
    assert {i: (r.monto_original, r.moneda_original, r.cost_center) for i, r in rows.items()} == {
        "g1": (1.5, "USD", "a\nb"), "h1": (4.0, "CLP", "d"), "k1": (7.0, "EUR", "x"),
    }
    assert json.loads(rows["h1"].csv_row) == {"moneda": "CLP", "AMOUNT": "4", "id": "h1", "date": "2000-12-03", "employee": "e3", "Category": "food", "costcenter": "d"}
    listed = list_processes(store.read("file_processes"), 10).collect()
    assert {r.filename: (r.status, r.total_records) for r in listed} == {"a.csv": ("COMPLETADO", 2), "b.csv": ("COMPLETADO", 1), "c.csv": ("COMPLETADO", 1), "d.csv": ("ERROR", 0)}
    assert sorted(r.process_seq for r in listed) == [0, 1, 2, 3] and all(r.created_at for r in listed)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "e.csv").write_text("id,monto\nz,1\n")
    ingest_into(store, str(tmp_path / "more"), 10)
    assert {r.filename: r.process_seq for r in store.read("file_processes").collect()}["e.csv"] == 4
    first = store.read("file_processes", at=1)
    assert {r.status for r in first.collect()} == {"PROCESANDO"} and store.read("file_process_batches").count() == 4
    outcomes = run_records(ingest_into(Store(spark, str(tmp_path / "other")), f"{tmp_path}/*.csv", 10), STANDARD_POLICY, STATIC_RATES)
    assert outcomes.count() == 3


def test_staging_leaves_nothing_behind(spark, tmp_path):
    with staging(spark):
        table = stage(spark.range(5), "scoped")
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_salted_dimension(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    dimension = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    for how in ("left", "inner", "left_anti"):
        want = sorted(map(str, rows.join(dimension, "k", how).collect()))
        assert sorted(map(str, dimension_join(rows, dimension, ["k"], [F.col("id")], how, limit=1, hot_rows=100).collect())) == want
    assert not is_small(spark.range(3).select(F.repeat(F.lit("x"), 100).alias("t")), size=200)


def test_dealt_rows_are_written_where_they_lie(spark, tmp_path):
    """Rows that lie by process are not moved again: each task adds its file to the groups it holds."""
    store = Store(spark, str(tmp_path))
    rows = spark.range(80, numPartitions=4).select(F.concat(F.lit("j"), "id").alias("job_id"), F.lit("p").alias("process_id"))
    with store.commit() as c:
        c.replace("job_runs", rows, dealt=True)
        c.replace("job_run_stages", rows)
    files = {n: [f for f in store.files.names(f"data/{store.files.names('data')[0]}/{n}/_group=p") if f.endswith(".parquet")] for n in ("job_runs", "job_run_stages")}
    assert len(files["job_runs"]) == 4 and len(files["job_run_stages"]) == 1 and all(".zstd." in f for f in files["job_runs"])
    assert store.read("job_runs", ["p"]).count() == store.read("job_run_stages", ["p"]).count() == 80


def test_ids_that_follow_from_positions_are_not_filed(spark, tmp_path):
    """Files hold no id that the position gives; any other id, null or not, comes back as it was, also after a merge."""
    position = "process_id string, batch_index int, record_index int"
    run = job_id(F.col("process_id"), F.col("batch_index"), F.col("record_index"))
    own = spark.createDataFrame([("p", 1, i) for i in range(20)], position).withColumn("job_id", run)
    strange = spark.createDataFrame([("p", 2, 1, None), ("p", 2, 2, "="), ("p", 2, 3, "=x"), ("p", 2, 4, "x"), ("p", 2, 5, ""), (None, None, None, None)], f"{position}, job_id string")
    runs = own.unionByName(strange)
    stages = runs.withColumn("stage_order", F.lit(2)).withColumn("id", F.concat_ws("-", "job_id", F.lit("2")))
    bare = strange.select("process_id", "job_id")
    store = Store(spark, str(tmp_path))
    for _ in range(FAN):
        with store.commit() as c:
            c.append("job_runs", runs)
            c.append("job_run_stages", stages)
            c.append("outcomes", bare)
    for _ in range(2):
        for name, rows in (("job_runs", runs), ("job_run_stages", stages), ("outcomes", bare)):
            got = [r for r in store.read(name).select(*rows.columns).collect()]
            assert sorted(map(str, got)) == sorted(map(str, rows.collect() * FAN))
        store.compact("job_runs", "job_run_stages", "outcomes")
    for name, columns in (("job_runs", ["job_id"]), ("job_run_stages", ["job_id", "id"])):
        filed = spark.read.parquet(f"{tmp_path}/data/*/{name}/*").where("batch_index = 1")
        assert filed.count() > 0 and all(filed.where(F.col(c).isNotNull()).isEmpty() for c in columns)


def test_stages_file_no_ids(spark, tmp_path):
    """The ids that ``job_stages`` makes are those that the store derives."""
    rows = spark.createDataFrame([(f"g{i}", "2000-12-01", float(i), "USD", "p", 0, 1, i + 1) for i in range(9)], "id string, fecha string, monto_original double, moneda_original string, process_id string, process_seq int, batch_index int, record_index int")
    rows = rows.withColumns({c: F.lit("x") for c in ("empleado_id", "categoria", "cost_center", "csv_row")} | {c: F.lit(None).cast("double") for c in ("monto_base", "tipo_cambio")})
    outcomes = stage(run_records(rows, STANDARD_POLICY, STATIC_RATES, as_of=date(2001, 1, 1)), "outcomes")
    store = Store(spark, str(tmp_path))
    with store.commit() as c:
        stored.store_outcomes(c, outcomes, STANDARD_POLICY)
    for name, whole in (("job_runs", job_runs(outcomes, STANDARD_POLICY)), ("job_run_stages", job_stages(outcomes))):
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, whole.collect()))
        filed = spark.read.parquet(f"{tmp_path}/data/*/{name}/*")
        assert filed.count() > 0 and filed.where(F.col("job_id").isNotNull()).isEmpty()


def test_numbering_stores_its_rows_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(numbering, "stage", lambda df, name: kept.append(name) or stage(df, name))
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    got = number_in_order(rows, "g", ["o"]).collect()
    assert sorted(kept) == ["offsets", "ordered"] and all(r.seq == r.o // 3 + 1 for r in got)


def test_dealt_rows_are_not_sorted(spark, tmp_path, monkeypatch):
    """A file stays open per group: wide rows are not sorted by group, also where a task has more groups than files it may open."""
    monkeypatch.setattr(session, "OPEN_FILES", 3)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(key), []
    write = DataFrameWriter.parquet

    def watched(self, path, *rest):
        plan = self._df._jdf.queryExecution().optimizedPlan().toString()
        seen.append(("Sort" in plan, self._df.sparkSession.conf.get(key)))
        write(self, path, *rest)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    rows = spark.range(100, numPartitions=2).select(F.concat(F.lit("j"), "id").alias("job_id"), (F.col("id") % 7).cast("string").alias("process_id"))
    store = Store(spark, str(tmp_path))
    with store.commit() as c:
        c.replace("job_runs", rows, dealt=True)
        c.replace("job_run_stages", rows)
    assert seen == [(False, "3"), (True, before)] and spark.conf.get(key) == before
    want = sorted(map(str, rows.collect()))
    assert sorted(map(str, store.read("job_runs").collect())) == want
    assert sorted(r.job_id for r in store.read("job_runs", ["5"]).collect()) == sorted(f"j{i}" for i in range(5, 100, 7))
