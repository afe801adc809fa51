"""ST-2: first-seen marks that expire, over event time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.lookup import HOT_ROWS
from ledgerloom.session import stage, staging
from ledgerloom.sources.tables import GROUPS, Store

FIRST = "first"
SKIPPED = "skipped"


def keep_first(events: DataFrame, keys: Sequence[str], ts: str, ttl_seconds: int) -> DataFrame:
    """ST-2 where dropping the duplicates is enough: Spark's own state does it."""
    return events.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(list(keys))


def _slice(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def _successors(points: DataFrame, probes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(origin, node): for each probe (keys, at, origin) the first point (keys, at, node) of its key at or after its time.

    Points and probes of a key meet in slices of time, each sorted on its own. A probe behind the last point of its slice takes
    the first one of the key's next slice that has any, found among one row per slice.
    """
    none = F.lit(None).cast("long")
    own = points.select(*keys, _slice(F.col("at"), width).alias("slice"), "at", "node", none.alias("origin"), F.lit(1).alias("kind"))
    asked = probes.select(*keys, _slice(F.col("at"), width).alias("slice"), "at", none.alias("node"), "origin", F.lit(0).alias("kind"))
    falling = Window.partitionBy(*keys, "slice").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    met = own.unionByName(asked).withColumn("hit", F.last("node", ignorenulls=True).over(falling)).where("kind = 0")
    met = stage(met.select(*keys, "slice", "origin", F.col("hit").alias("node")), "ttl-met")
    late = met.where("node is null")
    if late.isEmpty():
        return met.select("origin", "node")
    head = F.min(F.struct("at", "node"))["node"]
    heads = own.groupBy(*keys, "slice").agg(head.alias("head")).unionByName(late.select(*keys, "slice", none.alias("head")))
    heads = heads.groupBy(*keys, "slice").agg(F.max("head").alias("head"))
    after = Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    following = heads.withColumn("next", F.last("head", ignorenulls=True).over(after)).where("next is not null").select(*keys, "slice", "next")
    found = late.join(following, [*keys, "slice"]).select("origin", F.col("next").alias("node"))
    return met.where("node is not null").select("origin", "node").unionByName(found)


def _reach(starts: DataFrame, following: DataFrame) -> DataFrame:
    """The nodes on the chains from ``starts`` (node) along ``following`` (origin, node).

    Pointer doubling: each round the marked part of every chain doubles, and so does the length of a jump. n nodes of a
    chain take log2(n) + 1 rounds; jumps beyond a chain's end fall away.
    """
    marked, jump = [stage(starts, "ttl-marked")], stage(following, "ttl-jump")
    while True:
        known = reduce(DataFrame.unionByName, marked)
        more = stage(known.join(jump.withColumnRenamed("node", "to"), F.col("node") == F.col("origin")).select(F.col("to").alias("node")), "ttl-marked")
        if more.isEmpty():
            return known
        marked.append(more)
        then = jump.select(F.col("origin").alias("node"), F.col("node").alias("to"))
        jump = stage(jump.join(then, "node").select("origin", F.col("to").alias("node")), "ttl-jump")


def mark_first(
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    seconds: str,
    ttl_seconds: int,
    state: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(events with ``mark``, next state) for one bounded set of events.

    The first event of a key starts its time to live; duplicates do not extend it; the
    first event at or after the end starts the next one. Every event points to the one that would follow it, and the events on a key's
    chain of pointers are the first ones. A key's events are sorted in slices of one time to live, or of a fraction of it
    when a slice would hold more than ``hot_rows`` times. ``seconds`` is the event time as LONG microseconds, ``order``
    a unique LONG that breaks ties; events of one key and time are one point from the start.
    """
    keys = list(keys)
    ttl = ttl_seconds * 1_000_000
    events = stage(events, "ttl-events")
    points = events.groupBy(*keys, F.col(seconds).alias("at")).agg(F.min(order).alias("node"))
    points = stage(points, "ttl-points")
    most = points.groupBy(*keys, _slice(F.col("at"), ttl)).count().agg(F.max("count")).first()[0] or 0
    width = max(1, ttl // max(1, -(-most // hot_rows)))
    following = _successors(points, points.select(*keys, (F.col("at") + ttl).alias("at"), F.col("node").alias("origin")), keys, width)
    first = points.groupBy(*keys).agg(F.min(F.struct("at", "node"))["node"].alias("node"))
    if state is None:
        starts = first.select("node")
    else:
        known = state.select(*keys, "expires")
        waiting = first.join(known, keys).select(*keys, F.col("expires").alias("at"), F.col("node").alias("origin"))
        starts = first.join(known, keys, "left_anti").select("node").unionByName(_successors(points, waiting, keys, width).select("node"))
    accepted = stage(_reach(starts.where("node is not null"), following.where("node is not null")), "ttl-accepted")
    new = accepted.select(F.col("node").alias(order), F.lit(True).alias("_new"))
    marked = events.join(new, order, "left").withColumn("mark", F.when(F.col("_new"), F.lit(FIRST)).otherwise(F.lit(SKIPPED))).drop("_new")
    renewed = points.join(accepted, "node").groupBy(*keys).agg((F.max("at") + ttl).alias("expires"))
    if state is None:
        return marked, renewed
    renewed = stage(renewed, "ttl-renewed")
    return marked, state.select(*keys, "expires").join(renewed, keys, "left_anti").unionByName(renewed)


class TtlStream:
    """ST-2 with the duplicates written out as ``skipped``: table ``marked``, and the open keys in ``ttl_state``.

    A micro-batch is one commit of both tables, so a replay of a committed epoch does nothing and one of another starts from the same
    state. Only the buckets of the state with keys of the batch are read and written, and one more in turn. Keys whose
    time to live ended ``late_seconds`` before the newest event are forgotten: an event that comes later than that starts a new one.
    The state holds the keys of one time to live, however long the stream runs.
    """

    def __init__(self, store: Store, keys: Sequence[str], ts: str, order: str, ttl_seconds: int, late_seconds: int | None = None, name: str = "ttl"):
        self.store, self.keys, self.ts, self.order = store, list(keys), ts, order
        self.ttl_seconds, self.late_seconds, self.name = ttl_seconds, ttl_seconds if late_seconds is None else late_seconds, name

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if available_now else writer.start()

    def run(self, batch: DataFrame, epoch: int) -> None:
        store, note = self.store, self.store.mark(self.name) or {"epochs": 0, "newest": None}
        if note["epochs"] > epoch:
            return
        session = batch.sparkSession
        with staging(session), store.commit() as c:
            key = F.to_json(F.struct(*self.keys))
            timed = stage(batch.withColumn("_micros", F.unix_micros(F.col(self.ts).cast("timestamp"))), "ttl-batch")
            latest = timed.agg(F.max("_micros")).first()[0]
            newest = max((t for t in (latest, note["newest"]) if t is not None), default=0)
            near = store.touched("ttl_state", timed.select(key.alias("key")).distinct())
            near = sorted({*near, str(epoch % GROUPS["ttl_state"][1])})
            state = c.read("ttl_state", near) if c.exists("ttl_state") else None
            marked, now = mark_first(timed, self.keys, self.order, "_micros", self.ttl_seconds, state)
            c.append("marked", marked.drop("_micros"))
            kept = now.where(F.col("expires") > newest - self.late_seconds * 1_000_000)
            c.replace("ttl_state", kept.withColumn("key", key), near)
            c.marks[self.name] = {"epochs": epoch + 1, "newest": newest}
        store.compact("marked")
        store.vacuum()
