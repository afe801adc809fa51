"""Streams: replays, redelivery, pinned versions, looked-up history, expiring state."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.constants import STANDARD_POLICY, STATIC_RATES
from ledgerloom.sources.tables import Commit, Store
from ledgerloom.streaming import outcomes
from ledgerloom.streaming.dedup_ttl import TtlStream, mark_first
from ledgerloom.streaming.outcomes import RecordStream
from tests.test_edges import event

AS_OF = datetime(2001, 1, 1)
TABLES = ("expenses", "job_runs", "job_run_stages", "outcomes", "prints", "delivered")


def batch(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def enveloped(text: str, pattern: str = "expense.batch") -> str:
    return json.dumps({"pattern": pattern, "data": json.loads(text)})


def content(store: Store) -> dict[str, list]:
    return {n: sorted(map(str, store.read(n).drop("created_at", "finished_at").collect())) for n in TABLES if store.exists(n)}


def documents(spark, limit: int):
    policy = STANDARD_POLICY | {"limites_por_categoria": {"food": {"aprobado_hasta": limit, "pendiente_hasta": limit}}}
    at = F.lit("2001-01-01").cast("timestamp")
    return spark.range(1).select(F.lit("current").alias("name"), F.lit(json.dumps(policy)).alias("policies"), at.alias("created_at"), at.alias("updated_at"))


def test_an_epoch_that_was_lost_is_run_again_under_what_it_had_noted(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.write("validation_policies", documents(spark, 100))
    stream = RecordStream(store, None, STATIC_RATES, AS_OF)
    stream.run(batch(spark, enveloped(event("P0", 1, 1, 2))), 0)
    before = content(store)
    second = batch(spark, enveloped(event("P0", 2, 2, 29)), enveloped(event("P1", 1, 29, 30)))

    # the epoch dies before its commit; then the policy changes; then it is delivered again
    finish = Commit._finish
    monkeypatch.setattr(Commit, "_finish", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stream.run(second, 1)
    monkeypatch.setattr(Commit, "_finish", finish)
    assert content(store) == before
    store.write("validation_policies", documents(spark, 1))
    stream.run(second, 1)
    rows = {r["id"]: r["validation_status"] for r in store.read("expenses").collect()}
    assert rows["P0-29"] == "APROBADO" or rows["P0-29"] == "PENDIENTE"
    policies = {r["job_id"]: r["p"] for r in store.read("job_runs").where("status = 'success'").select("job_id", F.col("meta.validation.politicas").alias("p")).collect()}
    assert all(json.loads(p)["limites_por_categoria"]["food"]["aprobado_hasta"] == 100 for p in policies.values())

    # acknowledged but delivered again: nothing changes
    after, version = content(store), store.manifest()["version"]
    stream.run(second, 1)
    assert content(store) == after and store.manifest()["version"] == version
    assert {r["outcome"] for r in store.read("outcomes").where("id = 'P0-2'").collect()} == {"success", "duplicate_fingerprint"}

    # the next epoch works under the new policy
    stream.run(batch(spark, enveloped(event("P2", 1, 11))), 2)
    last = store.read("expenses").where("id = 'P2-11'").first()
    assert last["validation_status"] == "RECHAZADO"


def test_letters_are_tried_again_and_given_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outcomes, "MOST_ATTEMPTS", 3)
    store = Store(spark, str(tmp_path / "s"))
    stream = RecordStream(store, STANDARD_POLICY, STATIC_RATES, AS_OF)
    good = json.loads(event("", 0, 5))["records"][0]
    single = json.dumps({"pattern": "expense.created", "data": good})
    lines = [
        single, single, "{broken", "{broken", '{"data": {}}', '{"pattern": "", "data": {}}', '{"pattern": "expense.deleted", "data": {}}', "",
        '{"pattern": "expense.created", "data": {"id": "x"}}', '{"pattern": "expense.created", "data": 5}', '{"pattern": "expense.batch", "data": {"processId": "P", "batchIndex": 1, "records": {"id": "1"}}}',
    ]
    stream.run(batch(spark, *lines), 0)
    assert [(r["pattern"], r["status"]) for r in store.read("job_runs").collect()] == [("expense.created", "success")]
    waiting = {r["value"]: (r["attempts"], r["reason"]) for r in store.read("letters_waiting").collect()}
    assert {v: a for v, (a, _) in waiting.items()} == {"{broken": 1, '{"data": {}}': 1, '{"pattern": "", "data": {}}': 1, "": 1, lines[8]: 1, lines[9]: 1}
    assert waiting[lines[8]][1] == "registro inválido" and waiting["{broken"][1] == "sin pattern"
    for epoch in range(1, 3):
        stream.run(batch(spark, single), epoch)
    assert store.read("job_runs").count() == 1 and store.read("expenses").count() == 1
    assert store.read("letters_waiting").count() == 0
    assert {(r["value"], r["attempts"]) for r in store.read("letters_dead").collect()} == {(v, 3) for v in waiting}


def rows_scanned(df) -> int:
    df.collect()

    def walk(plan) -> int:
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        own = plan.metrics().apply("numOutputRows").value() if "Scan" in name else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_history_is_read_by_key(spark, tmp_path):
    """Looking up prints costs the same after many epochs, and groups keep few files."""
    store = Store(spark, str(tmp_path / "s"))
    prints = lambda lo, hi: spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    new = prints(10**6, 10**6 + 50)
    scanned = []
    for epoch in range(18):
        with store.commit() as c:
            c.append("prints", prints(epoch * 400, epoch * 400 + 400))
        store.compact("prints")
        if epoch in (1, 9, 17):
            scanned.append(rows_scanned(store.lookup("prints", "fingerprint", new)))
    assert scanned == [0, 0, 0]
    parts = [p for t in store.manifest()["tables"].values() for p in t["groups"].values()]
    assert max(map(len, parts)) <= 2 + 18 % 8 and store.read("prints").count() == 7200
    hits = store.lookup("prints", "fingerprint", prints(3, 5).union(new))
    assert hits.count() == 2 and rows_scanned(hits) < 1000
    store.vacuum()
    assert store.read("prints").distinct().count() == 7200
    many = store.lookup("prints", "fingerprint", prints(0, 6000))
    assert many.count() == 6000
    assert store.lookup("prints", "fingerprint", prints(0, 0)).count() == 0
    assert store.lookup("nothing", "fingerprint", new) is None


def test_a_clone_goes_its_own_way(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    store.write("expenses", spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("j").alias("job_id")))
    clone = store.clone(str(tmp_path / "b"))
    assert clone.read("expenses").inputFiles() == store.read("expenses").inputFiles()
    with clone.commit() as c:
        c.amend("expenses", spark.createDataFrame([("7",)], "id string"), "id")
    clone.vacuum(keep=1)
    assert (clone.read("expenses").count(), store.read("expenses").count()) == (49, 50)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Three years at one day: 1,096 lifetimes."""
    from ledgerloom.streaming import dedup_ttl

    rounds = []
    stage = dedup_ttl.stage
    monkeypatch.setattr(dedup_ttl, "stage", lambda df, name: (rounds.append(name), stage(df, name))[1])
    day = 86_400_000_000
    events = spark.range(0, 1096 * 3).select(F.col("id").alias("o"), F.lit("k").alias("k"), (F.floor(F.col("id") / 3) * day + F.pmod("id", F.lit(3)) * 1_000_000).alias("t"))
    marked, state = mark_first(events, ["k"], "o", "t", 86_400)
    got = {r["o"]: r["mark"] for r in marked.collect()}
    assert [o for o in got if got[o] == "first"] and all((got[o] == "first") == (o % 3 == 0) for o in got)
    assert rounds.count("ttl-marked") - 1 <= 12
    assert state.first()["expires"] == 1096 * day


def test_expiring_state_stays_small(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    stream = TtlStream(store, ["k"], "ts", "n", 86_400)
    rnd = random.Random(6)
    want, expires, n, sizes = {}, {}, 0, []
    for epoch in range(12):
        rows = []
        for _ in range(12):
            k = f"k{epoch // 2}-{rnd.randrange(4)}" if rnd.random() < 0.8 else "always"
            rows.append((n, k, epoch * 43_200 + rnd.randrange(43_200)))
            n += 1
        for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
            new = k not in expires or t >= expires[k]
            want[i] = "first" if new else "skipped"
            if new:
                expires[k] = t + 86_400
        df = spark.createDataFrame(rows, "n long, k string, t long").select("n", "k", F.timestamp_seconds("t").alias("ts"))
        stream.run(df, epoch)
        if epoch == 3:
            stream.run(df, epoch)  # delivered again
        sizes.append(store.read("ttl_state").count())
    assert {r["n"]: r["mark"] for r in store.read("marked").collect()} == want
    assert max(sizes[6:]) <= max(sizes[:6]) + 8 < len(expires)
    assert len(store.versions()) <= 3


def test_the_text_of_a_batch_is_not_stored_on_the_way(spark, tmp_path, monkeypatch):
    stored = []

    def kept(df, name):
        table = session.stage(df, name)
        stored.append((name, table))
        return table

    monkeypatch.setattr(outcomes, "stage", kept)
    monkeypatch.setattr(session, "remove", lambda *_: None)
    store = Store(spark, str(tmp_path / "s"))
    alone = json.dumps({"pattern": "expense.created", "data": {"id": "x", "monto": "5"}})
    RecordStream(store, STANDARD_POLICY, STATIC_RATES, AS_OF).run(batch(spark, enveloped(event("P0", 1, 1, 30)), alone, "{}"), 0)
    for name, table in stored:
        texts = [c for c, kind in table.dtypes if kind == "string"]
        assert not [r for r in table.select(texts).collect() for v in r if v and '"records"' in v], name
    letters = {(r.value, r.reason, r.attempts) for r in store.read("letters_waiting").collect()}
    assert letters == {(alone, outcomes.INVALID, 1), ("{}", "sin pattern", 1)}


def test_what_was_delivered_before_is_looked_for_once(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(outcomes, "stage", lambda df, name: names.append(name) or session.stage(df, name))
    stream = RecordStream(Store(spark, str(tmp_path / "s")), STANDARD_POLICY, STATIC_RATES, AS_OF)
    stream.run(batch(spark, enveloped(event("P0", 1, 1, 5))), 0)
    before = content(stream.store)
    stream.run(batch(spark, enveloped(event("P0", 1, 1, 5))), 1)
    assert content(stream.store) == before and names.count("undelivered") == 1
    stream.run(batch(spark, enveloped(event("P0", 2, 5, 9))), 2)  # nothing of it came before
    assert names.count("undelivered") == 1 and stream.store.read("outcomes").count() == 4
