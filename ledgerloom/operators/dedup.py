"""First-seen deduplication inside a process and against stored expenses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import DUPLICATE, DUPLICATE_DB
from ledgerloom.functions.identity import arrival
from ledgerloom.operators.lookup import HOT_ROWS, dimension_join, group_join
from ledgerloom.session import stage

KEYS = ["process_id", "fingerprint"]


def mark_duplicates(
    rows: DataFrame,
    candidates: DataFrame | None = None,
    persisted: DataFrame | None = None,
    seen: DataFrame | None = None,
    in_sequence: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """W-02/W-03/J-02: add ``duplicate`` (reason or null).

    ``rows`` needs process_id, process_seq, batch_index, record_index and
    fingerprint.  ``candidates`` holds the same rows with ``persistable``: would
    this row be stored if it came first?  With ``in_sequence`` the processes run one
    after another (by process_seq, then process_id), so a fingerprint stored by an earlier
    process is a stored duplicate in a later one.  Positions must be unique; see
    ``delivered_once`` for events that may come twice.  ``persisted`` are fingerprints stored before this
    run, ``seen`` are (process_id, fingerprint) keys still alive from earlier runs.

    Everything is decided on one row per (process, fingerprint), reduced map-side and
    stored, since several joins read it; the rows themselves move once, in
    ``group_join``.
    """
    if candidates is None:
        candidates = rows.withColumn("persistable", F.lit(True))
    # the smallest code is the first arrival; its last bit says whether that row is storable
    code = arrival(F.col("batch_index"), F.col("record_index")) * 2 + F.col("persistable").cast("long")
    groups = candidates.groupBy(*KEYS, "process_seq").agg(
        F.count("*").alias("_rows"), F.min(code).alias("_first")
    )
    groups = stage(groups, "dedup-groups")
    if seen is not None:
        groups = groups.join(seen.select(*KEYS).distinct().withColumn("_seen", F.lit(True)), KEYS, "left")
    else:
        groups = groups.withColumn("_seen", F.lit(None).cast("boolean"))
    # a common fingerprint stands in most processes: what is known of it is found once per fingerprint
    turn = F.struct("process_seq", "process_id")
    storable = (F.col("_first") % 2 == 1) & F.col("_seen").isNull() & F.lit(in_sequence)
    facts = groups.groupBy("fingerprint").agg(
        F.count("*").alias("_prints"), F.min(F.when(storable, turn)).alias("_first_process")
    )
    if persisted is not None:
        stored = persisted.select("fingerprint").distinct().withColumn("_stored", F.lit(True))
        facts = facts.join(stored, "fingerprint", "left")
    else:
        facts = facts.withColumn("_stored", F.lit(None).cast("boolean"))
    if in_sequence or persisted is not None:
        spread = F.abs(F.xxhash64(*KEYS) % (1 << 40)) + 1
        groups = group_join(groups, facts, ["fingerprint"], "_prints", spread, hot_rows)
        earlier = F.coalesce(F.col("_first_process") < turn, F.lit(False))
    else:
        groups = groups.withColumn("_stored", F.lit(None).cast("boolean"))
        earlier = F.lit(False)
    verdicts = groups.select(
        *KEYS,
        "_rows",
        F.shiftright("_first", 1).alias("_first"),
        F.coalesce("_seen", F.lit(False)).alias("_seen"),
        (F.coalesce("_stored", F.lit(False)) | earlier).alias("_db"),
    )
    position = arrival(F.col("batch_index"), F.col("record_index"))
    joined = group_join(rows, verdicts, KEYS, "_rows", position, hot_rows)
    reason = (
        F.when(F.col("_seen"), F.lit(DUPLICATE))
        .when(F.col("_db"), F.lit(DUPLICATE_DB))
        .when(position != F.col("_first"), F.lit(DUPLICATE))
    )
    return joined.withColumn("duplicate", reason).drop("_rows", "_first", "_seen", "_db")


def delivered_once(events: DataFrame) -> DataFrame:
    """ST-3: one row per record position, whichever delivery of it is read first."""
    return events.dropDuplicates(["process_id", "batch_index", "record_index"])


def first_deliveries(events: DataFrame) -> DataFrame:
    """``delivered_once`` for stored events with their ``delivery`` (a batch, or a single record): only those delivered more than once move.

    The positions in one delivery of a batch count from 1, so a batch with more rows than its largest position came more than once.
    """
    alone = F.coalesce(F.col("process_id") == "", F.lit(False))
    counts = events.groupBy("delivery").agg(
        F.count_if(alone).alias("_alone"),
        F.count_if(~alone).alias("_rows"),
        F.max(F.when(~alone, F.col("record_index"))).alias("_last"),
    )
    often = counts.where((F.col("_alone") > 1) | (F.col("_rows") > F.coalesce("_last", F.lit(0))))
    often = stage(often.select("delivery"), "delivered-often")
    if often.isEmpty():
        return events
    at = [F.col("batch_index"), F.col("record_index")]
    once, again = (dimension_join(events, often, ["delivery"], at, how).select(*events.columns) for how in ("left_anti", "left_semi"))
    # stored, because which of several deliveries is kept must not differ between readers
    return once.unionByName(stage(delivered_once(again), "delivered-once"))


def first_seen(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """W-02 alone: processes do not see each other."""
    return mark_duplicates(rows, in_sequence=False, hot_rows=hot_rows)


def not_persisted(rows: DataFrame, persisted: DataFrame) -> DataFrame:
    """J-02: rows whose fingerprint is not stored yet.

    Existence is decided per distinct fingerprint, then brought back to the rows.
    """
    groups = rows.groupBy("fingerprint").agg(F.count("*").alias("_rows"))
    stored = persisted.select("fingerprint").distinct().withColumn("_stored", F.lit(True))
    known = groups.join(stored, "fingerprint", "left").withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    spread = F.abs(F.xxhash64(*[F.col(c) for c in ("process_id", "batch_index", "record_index")]) % (1 << 40)) + 1
    joined = group_join(rows, known, ["fingerprint"], "_rows", spread)
    return joined.where(~F.col("_stored")).drop("_rows", "_stored")
