"""The registered queries: every operator over the sample tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import date
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.constants import (
    APROBADO,
    COMPLETADO,
    PENDIENTE,
    STANDARD_POLICY,
    STATIC_RATES,
)
from ledgerloom.functions.identity import dedup_key, fingerprint
from ledgerloom.functions.meta import display_status, merge_meta, meta_has, meta_path
from ledgerloom.functions.numbers import parse_number
from ledgerloom.functions.text import parse_result, safe_name
from ledgerloom.operators import fx, rules
from ledgerloom.operators.abort import abort_batches, cut_at
from ledgerloom.operators.contract import contract_errors
from ledgerloom.operators.dedup import first_seen, mark_duplicates, not_persisted
from ledgerloom.operators.lookup import keep_where, spread
from ledgerloom.operators.mapping import map_columns, map_records, quarantined, valid, valid_records
from ledgerloom.operators.policy import (
    base_currency,
    literal_policy,
    parsed,
    policy_contract_errors,
    policy_errors,
    resolved_policy,
    unwrap_policy,
)
from ledgerloom.operators.upsert import upsert_policies
from ledgerloom.plans import maintenance, reports, stored
from ledgerloom.plans.audit import new_expenses, upsert_expenses
from ledgerloom.plans.ingest import file_batches, file_totals, ingest_into, progress
from ledgerloom.plans.outcomes import normalize_amount, price, run_records, unpacked, with_fingerprint
from ledgerloom.plans.regression import evaluate_history, mismatches, with_results
from ledgerloom.plans.validate import status_breakdown, status_by_process, validate, validate_priced, validate_tenants
from ledgerloom.session import new_path, stage, tune
from ledgerloom.sources import bridge
from ledgerloom.sources.events import BATCH, RECORD_CREATED, envelope, write_batch_events
from ledgerloom.sources.files import RESULT_COLUMN, admissible_files, read_results_csv, write_results_csv
from ledgerloom.sources.tables import Store
from ledgerloom.streaming.dedup_ttl import TtlStream
from ledgerloom.streaming.metrics import metrics_stream, read_metrics
from ledgerloom.streaming.outcomes import RecordStream
from ledgerloom.workspace import AS_OF, RATES, workspace

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register ``q_name`` as ``name``, run under the recommended settings."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tune(spark), sf_dir)

    REGISTRY[build.__name__.removeprefix("q_")] = run
    return run


def _text_time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def _messages(alerts: str) -> Column:
    return F.array_join(F.col(f"{alerts}.mensaje"), "||")


def _expenses(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """Canonical expenses without positions: no query on them needs an order."""
    columns = bridge.COLUMNS + (bridge.EXTRA if extra else [])
    return valid(map_columns(bridge.records(spark, sf_dir), columns))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_priced(_expenses(spark, sf_dir), STANDARD_POLICY, STATIC_RATES, AS_OF)


# ------------------------------------------------------------------ validation
@query
def q_status_breakdown(spark, sf_dir):
    return status_breakdown(_evaluated(spark, sf_dir))


@query
def status_by_process_pivot(spark, sf_dir):
    return status_by_process(_evaluated(spark, sf_dir))


def _one_rule(spark, sf_dir, rule, *by: str) -> DataFrame:
    judged = validate_priced(_expenses(spark, sf_dir), STANDARD_POLICY, STATIC_RATES, AS_OF, rules=[rule])
    first = F.try_element_at("alertas", F.lit(1))
    return (
        judged.select(
            *by, F.col("status").alias("estado"), first["codigo"].alias("codigo"), first["mensaje"].alias("mensaje")
        )
        .groupBy(*by, "estado", "codigo", "mensaje")
        .agg(F.count("*").alias("expenses"))
    )


@query
def rule_age(spark, sf_dir):
    return _one_rule(spark, sf_dir, rules.AGE, "fecha")


@query
def rule_category(spark, sf_dir):
    return _one_rule(spark, sf_dir, rules.CATEGORY, "categoria")


@query
def rule_cost_center(spark, sf_dir):
    return _one_rule(spark, sf_dir, rules.COST_CENTER, "cost_center", "categoria")


@query
def validation_alerts(spark, sf_dir):
    return rules.alert_rows(_evaluated(spark, sf_dir), "process_id", "id", "empleado_id")


@query
def rule_suggestions(spark, sf_dir):
    return (
        rules.suggestion_rows(_evaluated(spark, sf_dir), "process_id")
        .groupBy("process_id", "orden", "regla", "estado")
        .agg(F.count("*").alias("expenses"))
    )


@query
def alert_counts(spark, sf_dir):
    return rules.alert_counts(_evaluated(spark, sf_dir))


@query
def custom_rule(spark, sf_dir):
    """A user rule after the standard ones, with rates from a provider."""

    def round_amount(policy, e):
        hit = F.pmod(e.amount, F.lit(50.0)) == 0
        return rules.RuleResult(
            F.when(hit, F.lit(PENDIENTE)).otherwise(F.lit(APROBADO)),
            F.when(hit, rules.alert("MONTO_REDONDO", F.concat(F.lit("Monto redondo: "), e.amount_text))),
        )

    provider = fx.static_provider(STATIC_RATES, "USD")
    positive = normalize_amount(_expenses(spark, sf_dir)).where(~F.col("negative_amount_detected"))
    priced = price(positive, fx.pair_rates(provider(spark)), "USD")
    judged = rules.evaluate(
        priced.drop("monto_base").withColumnRenamed("base_amount", "monto_base"),
        literal_policy(STANDARD_POLICY),
        AS_OF,
        rules=[*rules.STANDARD_RULES, rules.Rule("RoundAmountRule", round_amount)],
    )
    full = rules.full_result(judged, literal_policy(STANDARD_POLICY))
    return (
        full.select(
            "status",
            F.size("sugerencias").alias("suggestions"),
            "monedaBase",
            F.array_join(F.col("alertas.codigo"), ",").alias("codes"),
        )
        .groupBy("status", "suggestions", "monedaBase", "codes")
        .agg(F.count("*").alias("expenses"))
    )


# --------------------------------------------------------------------- mapping
@query
def parse_numbers(spark, sf_dir):
    lines = bridge.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    price_text = F.col("l_extendedprice").cast("string")
    quantity = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    cell = (
        F.when(n == 1, F.translate(price_text, ".", ","))
        .when(n == 2, F.concat(F.lit(" \t"), price_text, F.lit("  ")))
        .when(n == 3, F.concat(F.lit("1,"), price_text))
        .when(n == 4, F.concat(price_text, F.lit("d")))
        .when(n == 5, F.lit("  "))
        .when(n == 6, F.concat(quantity, F.lit("e2")))
        .otherwise(F.concat(F.lit("-"), quantity, F.lit(",5")))
    )
    return lines.withColumn("cell", cell).select(
        "l_orderkey", "l_linenumber", "l_partkey", parse_number(F.col("cell")).alias("amount")
    )


@query
def alias_mapping(spark, sf_dir):
    """Records whose keys differ by process, spelled with blanks and capitals."""
    raw = bridge.records(spark, sf_dir)
    spellings = [
        {"id": " ID ", "fecha": "FECHA", "monto": "Monto ", "moneda": "moneda", "cc": "Centro_Costo", "cat": "categoria"},
        {"id": "expense_id", "fecha": "date", "monto": "amount", "moneda": "currency", "cc": "costcenter", "cat": "Category"},
        {"id": "gasto_id", "fecha": "fecha_gasto", "monto": "importe", "moneda": "currency_code", "cc": "cost_center_id", "cat": "categoria"},
        {"id": "gasto_id", "fecha": "expense_date", "monto": "monto_original", "moneda": "MONEDA_ORIGINAL", "cc": "empleado_cost_center", "cat": "category"},
    ]

    def record(s: dict[str, str]) -> Column:
        pairs = {
            s["id"]: "gasto_id",
            s["fecha"]: "fecha",
            s["monto"]: "monto",
            s["moneda"]: "moneda",
            s["cc"]: "empleado_cost_center",
            s["cat"]: "categoria",
            "Employee": "empleado_id",
        }
        cells = []
        for key, source in pairs.items():
            padded = F.concat(F.lit(" "), F.col(source), F.lit(" ")) if source != "monto" else F.col(source)
            cells += [F.lit(key), padded]
        return F.create_map(*cells)

    style = F.pmod("process_seq", F.lit(4))
    chosen = F.when(style == 0, record(spellings[0]))
    for i in (1, 2):
        chosen = chosen.when(style == i, record(spellings[i]))
    mapped = map_records(raw.withColumn("record", chosen.otherwise(record(spellings[3]))))
    return valid_records(mapped).select(
        "process_id", "id", "empleado_id", "fecha", "monto_original", "moneda_original", "categoria", "cost_center"
    )


@query
def missing_fields(spark, sf_dir):
    """Wide rows with blank cells; an empty ``id`` hides ``gasto_id``, a later clash of headers wins."""
    n = F.col("l_linenumber")
    raw = bridge.records(spark, sf_dir).select(
        "process_id",
        "process_seq",
        F.when(n == 1, F.lit("")).otherwise(F.col("gasto_id")).alias("id"),
        "gasto_id",
        F.col("empleado_id").alias("Empleado_ID"),
        F.when(n == 2, F.lit("  ")).otherwise(F.col("fecha")).alias("FECHA"),
        F.when(n == 3, F.lit("n/a")).otherwise(F.col("monto")).alias("monto"),
        F.when(n == 3, F.lit(None).cast("string")).otherwise(F.col("moneda")).alias("moneda"),
        "categoria",
        "empleado_cost_center",
    )
    columns = [c for c in raw.columns if c not in ("process_id", "process_seq")]
    return (
        quarantined(map_columns(raw, columns), columns)
        .select("process_id", F.array_join("missing", ",").alias("missing"), "error")
        .groupBy("process_id", "missing", "error")
        .agg(F.count("*").alias("records"))
    )


# ---------------------------------------------------------------- fingerprints
@query
def fingerprints(spark, sf_dir):
    return with_fingerprint(_expenses(spark, sf_dir)).select(
        "process_id", "id", "fingerprint", dedup_key(F.col("process_id"), F.col("fingerprint")).alias("dedup_key")
    )


@query
def wide_fingerprint(spark, sf_dir):
    """The wider field set tells apart what the narrow one calls a duplicate."""
    wide = ("fecha", "monto_original", "moneda_original", "empleado_id", "categoria", "cost_center")
    rows = with_fingerprint(_expenses(spark, sf_dir)).withColumn("wide", fingerprint(wide))
    narrow = rows.groupBy("process_id", "fingerprint").agg(F.count("*").alias("records"), F.min("wide").alias("lo"), F.max("wide").alias("hi"))
    return (
        narrow.where(F.col("records") > 1)
        .groupBy("process_id")
        .agg(
            F.count("*").alias("repeated_prints"),
            F.count_if(F.col("lo") != F.col("hi")).alias("told_apart"),
            F.min("lo").alias("smallest_wide"),
        )
    )


POSITION = ["process_id", "batch_index", "record_index"]


def _printed(spark, sf_dir) -> DataFrame:
    """Positions, ids and fingerprints; these as bytes, half as long as their digits, until ``_digits``."""
    rows = with_fingerprint(workspace(spark, sf_dir).expenses_in).withColumn("fingerprint", F.unhex("fingerprint"))
    return rows.select(*POSITION, "process_seq", "id", "fingerprint")


def _digits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


@query
def dedup_first_seen(spark, sf_dir):
    firsts = first_seen(_printed(spark, sf_dir)).where(F.col("duplicate").isNull())
    return _digits(firsts.drop("duplicate", "process_seq"))


@query
def dedup_skipped(spark, sf_dir):
    skipped = first_seen(_printed(spark, sf_dir)).where(F.col("duplicate").isNotNull())
    return _digits(skipped.withColumnRenamed("duplicate", "reason").drop("process_seq"))


@query
def dedup_against_persisted(spark, sf_dir):
    """Stored: the fingerprints of the first process.  Incoming: all others."""
    rows = _printed(spark, sf_dir)
    stored = rows.where(F.col("process_seq") == 0).select("fingerprint")
    incoming = rows.where(F.col("process_seq") > 0)
    marked = mark_duplicates(incoming, persisted=stored, in_sequence=False)
    return marked.where(F.col("duplicate").isNotNull()).select(
        *POSITION, "id", F.col("duplicate").alias("reason")
    )


@query
def not_yet_persisted(spark, sf_dir):
    rows = _printed(spark, sf_dir)
    stored = rows.where(F.col("process_seq") == 0)
    return _digits(not_persisted(rows.where(F.col("process_seq") > 0), stored).select(*POSITION, "fingerprint"))


@query
def negative_skipped(spark, sf_dir):
    return (
        normalize_amount(_expenses(spark, sf_dir))
        .where("negative_amount_detected")
        .select("process_id", "id", "fecha", "monto_original", "monto_normalizado")
    )


# -------------------------------------------------------------------------- fx
def _items(spark, sf_dir) -> DataFrame:
    return normalize_amount(_expenses(spark, sf_dir)).select(
        "process_id", "id", "fecha", F.col("monto_normalizado").alias("monto_original"), "moneda_original"
    )


CONVERTED = ["process_id", "id", "fecha", "moneda_original", "moneda_base", "monto_convertido", "tipo_cambio", "error"]


@query
def convert_pairs(spark, sf_dir):
    pairs = bridge.dated_pairs(spark, sf_dir, RATES)
    return fx.convert(_items(spark, sf_dir), pairs, "USD").select(*CONVERTED, "rate_source")


@query
def convert_cross_rates(spark, sf_dir):
    long = fx.rates_from_tables(bridge.dated_tables(spark, sf_dir, STATIC_RATES))
    return fx.convert(_items(spark, sf_dir), fx.cross_rates(long, "EUR"), "EUR").select(*CONVERTED)


@query
def effective_rates(spark, sf_dir):
    priced = price(normalize_amount(_expenses(spark, sf_dir, extra=True)), RATES, None, "usd")
    return priced.select(
        "process_id", "id", "fecha", "monto_original", "base_currency", "base_amount", "exchange_rate", "rate_source"
    )


@query
def fx_pairs_needed(spark, sf_dir):
    needed = fx.pairs_needed(_expenses(spark, sf_dir), "USD")
    return fx.materialize_pairs(needed, bridge.dated_pairs(spark, sf_dir, RATES).drop("fetched_at", "ttl_seconds"))


def _entries(spark, sf_dir, as_of: str, kind: str = "all", day: str | None = None) -> DataFrame:
    return fx.live_entries(
        bridge.dated_pairs(spark, sf_dir, STATIC_RATES),
        bridge.dated_tables(spark, sf_dir, STATIC_RATES),
        F.lit(as_of).cast("timestamp"),
        kind,
        day,
    )


@query
def fx_listing(spark, sf_dir):
    listed = fx.listing(_entries(spark, sf_dir, "1998-06-01 12:00:00"))
    return listed.select("key", "prefix", "date", "from_ccy", "to_ccy", "rate", "base", "currencies", "ttl_left")


@query
def fx_live(spark, sf_dir):
    rates = fx.rates_from_tables(bridge.dated_tables(spark, sf_dir, STATIC_RATES))
    return fx.live(rates, F.lit("1998-01-01 12:00:00").cast("timestamp")).select("date", "base", "currency", "rate")


@query
def fx_purged(spark, sf_dir):
    entries = _entries(spark, sf_dir, "1998-06-01 12:00:00")
    left, removed = fx.purge(entries, "fx", "1998-06-01")
    counted = left.groupBy("prefix").agg(F.count("*").alias("entries"))
    return counted.unionByName(removed.select(F.lit("deleted").alias("prefix"), F.col("deleted").alias("entries")))


# -------------------------------------------------------------------- contract
@query
def contract_violations(spark, sf_dir):
    """Zero amounts, impossible days and missing rates."""
    raw = bridge.records(spark, sf_dir, F.col("l_quantity") - 1).withColumn(
        "fecha",
        F.when(F.col("l_linenumber") == 7, F.concat(F.substring("fecha", 1, 8), F.lit("32")))
        .when(F.col("l_linenumber") == 6, F.translate("fecha", "-", "/"))
        .otherwise(F.col("fecha")),
    )
    priced = price(normalize_amount(valid(map_columns(raw, bridge.COLUMNS))), STATIC_RATES, "USD")
    errors = contract_errors(F.col("monto_normalizado"), F.col("base_amount"))
    judged = validate(priced.drop("monto_base").withColumn("monto_base", F.lit(None).cast("double")), STANDARD_POLICY, AS_OF)
    return (
        judged.select("moneda_original", F.array_join(errors, ". ").alias("violations"), F.col("error").alias("rule_error"))
        .groupBy("moneda_original", "violations", "rule_error")
        .agg(F.count("*").alias("records"))
    )


# ------------------------------------------------------------------- ingestion
@query
def batches(spark, sf_dir):
    """Numbers all records anew, in arrival order."""
    return (
        workspace(spark, sf_dir)
        .ingest()
        .groupBy("process_id", "batch_index")
        .agg(
            F.count("*").alias("records"),
            F.min("record_index").alias("first_record"),
            F.max("record_index").alias("last_record"),
            F.min("l_orderkey").alias("first_order"),
        )
    )


@query
def batch_metadata(spark, sf_dir):
    space = workspace(spark, sf_dir)
    return file_batches(space.records, space.columns).withColumn("expense_ids", F.array_join("expense_ids", ","))


@query
def ingest_progress(spark, sf_dir):
    return progress(workspace(spark, sf_dir).batches)


@query
def q_file_totals(spark, sf_dir):
    return file_totals(workspace(spark, sf_dir).records)


@query
def csv_ingest(spark, sf_dir):
    """The records as CSV files with three different headers and line breaks in cells: ingested, stored, run."""
    space = workspace(spark, sf_dir)
    root = new_path(spark, "csv-ingest")
    headers = {
        "a": ["gasto_id", "empleado_id", "fecha", "monto", "moneda", "categoria", "empleado_cost_center"],
        "b": ["Amount", " DATE ", "expense_id", "currency", "Category", "costcenter", "employee"],
        "c": ["nota", "moneda", "importe", "ID", "fecha_gasto", "empleado_id", "cost_center", "category"],
    }
    source = {
        "Amount": "monto", " DATE ": "fecha", "expense_id": "gasto_id", "currency": "moneda", "Category": "categoria", "costcenter": "empleado_cost_center",
        "employee": "empleado_id", "importe": "monto", "ID": "gasto_id", "fecha_gasto": "fecha", "cost_center": "empleado_cost_center", "category": "categoria",
    }
    rows = space.records.withColumn("nota", F.concat(F.lit('línea 1, "x"\n'), F.col("gasto_id")))
    for i, (folder, names) in enumerate(headers.items()):
        mine = rows.where(F.pmod("process_seq", F.lit(3)) == i)
        mine.select(*[F.col(source.get(n, n)).alias(n) for n in names]).write.option("header", True).option("quoteAll", True).option(
            "escape", '"'
        ).csv(f"{root}/{folder}")
    store = Store(spark, f"{root}-store")
    outcomes = run_records(ingest_into(store, f"{root}/*", bridge.BATCH_SIZE), STANDARD_POLICY, STATIC_RATES, AS_OF)
    known = reports.list_processes(store.read("file_processes"), 200).agg(F.count_if(F.col("status") == COMPLETADO) > 0).first()[0]
    order = F.split(F.substring("id", 2, 40), "-")[0].cast("long")
    return outcomes.groupBy(F.concat(F.lit("P"), order % 8).alias("process_id"), "moneda_original").agg(
        F.count("*").alias("records"), F.sum("monto_original").alias("amount"), F.lit(known).alias("completed")
    )


# -------------------------------------------------------------------- outcomes
def _flat_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        "job_id",
        "id",
        "fingerprint",
        "outcome",
        "run_status",
        "base_amount",
        "exchange_rate",
        "validation_status",
        _messages("validation_alerts").alias("messages"),
        "failed_stage",
    )


@query
def record_outcomes(spark, sf_dir):
    """The whole record plan over the numbered records, not read from a stored result."""
    return _flat_outcomes(workspace(spark, sf_dir).run())


@query
def job_stages(spark, sf_dir):
    return workspace(spark, sf_dir).stages.select(
        "job_id",
        "stage",
        "stage_order",
        "status",
        F.col("data.source").alias("source"),
        F.col("data.reason").alias("reason"),
        F.col("data.base_amount").alias("base_amount"),
        F.col("data.alertas_count").alias("alertas_count"),
        "error",
    )


@query
def expenses_upserted(spark, sf_dir):
    """The first four processes are stored already; the others replace rows by id."""
    outcomes = workspace(spark, sf_dir).outcomes
    before = new_expenses(outcomes.where(F.col("process_seq") < 4))
    after = upsert_expenses(before, outcomes.where(F.col("process_seq") >= 4))
    return after.select(
        "id", "job_id", "fecha", "monto_original", "moneda_original", "monto_base", "tipo_cambio", "validation_status"
    )


@query
def batch_abort(spark, sf_dir):
    """Strict mode over amounts that may be zero: what a batch keeps up to its first error."""
    numbered = workspace(spark, sf_dir).records
    amount = F.when(
        (F.pmod("l_orderkey", F.lit(97)) == 5) & (F.col("l_linenumber") == 2), F.lit("0")
    ).otherwise(F.col("monto"))
    expenses = with_fingerprint(valid(map_columns(numbered.withColumn("monto", amount), bridge.COLUMNS)))
    rows = expenses.select(*POSITION, F.unhex("fingerprint").alias("fingerprint"), (F.col("monto_original") == 0).alias("error"))
    cuts = abort_batches(rows)
    kept = cut_at(rows, cuts).groupBy("process_id", "batch_index").agg(F.count("*").alias("processed"))
    return kept.join(cuts, ["process_id", "batch_index"], "left")


# ------------------------------------------------------------------- read side
@query
def process_summary(spark, sf_dir):
    space = workspace(spark, sf_dir)
    return reports.process_summary(space.processes, space.runs, space.expenses).drop("created_at", "storage_uri")


@query
def anomaly_summary(spark, sf_dir):
    return reports.anomaly_summary(workspace(spark, sf_dir).runs)


def _audit(spark, sf_dir, kind: str) -> DataFrame:
    return stored.audit(workspace(spark, sf_dir).tables, "P3", kind).select(
        "job_id",
        "expense_id",
        "fingerprint",
        _text_time("created_at").alias("created_at"),
        F.coalesce("meta.dedup.reason", "meta.negative_amount.reason").alias("reason"),
        "expense_fecha",
        "expense_moneda_original",
        "expense_monto_original",
        "expense_validation_status",
    )


@query
def audit_duplicates(spark, sf_dir):
    return _audit(spark, sf_dir, "duplicate")


@query
def audit_negatives(spark, sf_dir):
    return _audit(spark, sf_dir, "negative")


@query
def report_rows(spark, sf_dir):
    return stored.report(workspace(spark, sf_dir).tables, "P3")


@query
def jobs_page(spark, sf_dir):
    page = reports.list_jobs(workspace(spark, sf_dir).runs, page=3, page_size=40, status="success", process_id="P5")
    return page.select(
        "job_id", "expense_id", "status", _text_time("created_at").alias("created_at"), "display_status"
    )


@query
def job_page_info(spark, sf_dir):
    """A page far beyond the end, and one filtered by validation status."""
    runs = workspace(spark, sf_dir).runs
    beyond = reports.page_info(runs, page=1_000_000, page_size=500, status="failed")
    pending = reports.page_info(runs, page=2, validation_status=PENDIENTE, process_id="P2")
    return beyond.unionByName(pending)


@query
def job_detail_stages(spark, sf_dir):
    space = workspace(spark, sf_dir)
    runs = reports.filter_runs(space.runs, process_id="P2")
    detail = reports.job_detail(runs, space.stages.where(F.col("process_id") == "P2"), ("stage", "status"))
    steps = F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["status"]))
    return detail.select(
        "job_id",
        display_status(F.col("status"), F.col("meta.validation.status")).alias("display_status"),
        F.array_join(steps, ">").alias("stages"),
    )


@query
def process_list(spark, sf_dir):
    listed = reports.list_processes(workspace(spark, sf_dir).processes, 5)
    return listed.select("process_id", "filename", "status", "total_records", _text_time("created_at").alias("created_at"))


@query
def process_batches(spark, sf_dir):
    listed = reports.process_batches(workspace(spark, sf_dir).batches, "P4")
    return listed.select("process_id", "batch_index", "record_count", F.size("expense_ids").alias("ids"))


@query
def meta_lookup(spark, sf_dir):
    """Audit metadata as JSON text, read by path and by key."""
    runs = workspace(spark, sf_dir).runs.withColumn("j", F.to_json("meta"))
    meta = F.col("j")
    return runs.groupBy(
        meta_path(meta, "process_id").alias("process_id"),
        meta_has(meta, "dedup").alias("has_dedup"),
        meta_path(meta, "dedup", "reason").alias("reason"),
        meta_path(meta, "validation", "status").alias("status"),
    ).agg(F.count("*").alias("runs"))


@query
def q_merge_meta(spark, sf_dir):
    meta = F.create_map(
        F.lit("id"), F.col("expense_id"), F.lit("state"), F.lit("open"), F.lit("fecha"), F.col("meta.fecha")
    )
    patch = F.create_map(F.lit("state"), F.col("status"), F.lit("reason"), F.coalesce("meta.dedup.reason", F.lit("-")))
    merged = workspace(spark, sf_dir).runs.select("job_id", F.explode(merge_meta(meta, patch)).alias("key", "value"))
    return merged.groupBy("key", "value").agg(F.count("*").alias("entries"))


# ----------------------------------------------------------------- maintenance
def _tables(store: Store) -> maintenance.Tables:
    return maintenance.Tables(*[store.read(n) for n in ("job_runs", "job_run_stages", "expenses", "file_process_batches", "file_processes")])


def _sizes(tables: maintenance.Tables) -> DataFrame:
    def count(name: str, df: DataFrame, detached: Column | None = None) -> DataFrame:
        return df.agg(
            F.count("*").alias("records"), F.count_if(F.lit(False) if detached is None else detached).alias("detached")
        ).select(F.lit(name).alias("table_name"), "records", "detached")

    out = count("expenses", tables.expenses, F.col("job_id").isNull())
    for name, df in (
        ("job_runs", tables.runs),
        ("job_run_stages", tables.stages),
        ("file_process_batches", tables.batches),
        ("file_processes", tables.processes),
    ):
        out = out.unionByName(count(name, df))
    return out


@query
def jobs_deleted(spark, sf_dir):
    store = workspace(spark, sf_dir).store()
    doomed = store.read("job_runs", ["P1"]).where((F.col("process_id") == "P1") & (F.col("status") != "skipped"))
    gone = stored.delete_jobs(store, doomed.select("job_id", "process_id"))
    return _sizes(_tables(store)).unionByName(
        spark.range(1).select(F.lit("deleted").alias("table_name"), F.lit(gone).cast("long").alias("records"), F.lit(0).cast("long").alias("detached"))
    )


@query
def process_deleted_soft(spark, sf_dir):
    store = workspace(spark, sf_dir).store()
    stored.delete_process(store, "P6")
    return _sizes(_tables(store))


@query
def process_deleted_hard(spark, sf_dir):
    store = workspace(spark, sf_dir).store()
    stored.delete_process(store, "P6", hard=True)
    return _sizes(_tables(store))


# ----------------------------------------------------------------- regressions
def _history(spark, sf_dir) -> DataFrame:
    expenses = map_columns(bridge.records(spark, sf_dir), bridge.COLUMNS)
    return evaluate_history(valid(expenses), STANDARD_POLICY, STATIC_RATES, AS_OF)


@query
def result_text(spark, sf_dir):
    return with_results(_history(spark, sf_dir)).select("process_id", "id", "empleado_id", RESULT_COLUMN)


@query
def result_text_parsed(spark, sf_dir):
    texts = with_results(_history(spark, sf_dir)).select(RESULT_COLUMN)
    parsed = texts.select(
        parse_result(F.col(RESULT_COLUMN)).alias("full"),
        parse_result(F.col(RESULT_COLUMN), first_only=True).alias("first"),
    )
    return (
        parsed.select(
            "full.status",
            F.size("full.alertas").alias("alerts"),
            F.size("first.alertas").alias("first_alerts"),
            F.try_element_at("first.alertas", F.lit(1)).alias("first_message"),
        )
        .groupBy("status", "alerts", "first_alerts", "first_message")
        .agg(F.count("*").alias("expenses"))
    )


@query
def historical_regression(spark, sf_dir):
    """A results file recorded some days earlier, checked against today's evaluation."""
    raw = bridge.records(spark, sf_dir).select("process_id", *bridge.COLUMNS)
    expenses = valid(map_columns(raw, bridge.COLUMNS, keep=["gasto_id", "monto", "moneda", "empleado_cost_center"]))
    recorded = with_results(evaluate_history(expenses, STANDARD_POLICY, STATIC_RATES, date(2000, 11, 20)))
    path = new_path(spark, "results")
    write_results_csv(recorded.select("process_id", *bridge.COLUMNS, RESULT_COLUMN), path)
    rows, columns = read_results_csv(spark, path)
    again = valid(map_columns(rows, columns, keep=[RESULT_COLUMN]))
    wrong = mismatches(evaluate_history(again, STANDARD_POLICY, STATIC_RATES, AS_OF))
    return wrong.select(
        "process_id", "id", "empleado_id", F.col("expected.status").alias("recorded"), "status",
        F.size("expected.alertas").alias("recorded_alerts"), F.size("alertas").alias("alerts"),
    )


# -------------------------------------------------------------------- policies
def _documents(spark, sf_dir) -> DataFrame:
    """One policy document per customer, some of them broken in one way each."""
    customers = spread(bridge.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    key = F.col("c_custkey").cast("string")
    limit = F.pmod("c_custkey", F.lit(90)) + 10
    base = F.element_at(F.array(*[F.lit(c) for c in ("USD", "CLP", " mxn ", "EUR")]), F.pmod("c_nationkey", F.lit(4)) + 1)
    good = F.format_string(
        '{"moneda_base":"%s","limite_antiguedad":{"pendiente_dias":%d,"rechazado_dias":%d},'
        '"limites_por_categoria":{"food":{"aprobado_hasta":%d,"pendiente_hasta":%d}},'
        '"reglas_centro_costo":[{"cost_center":"%s","categoria_prohibida":"food"}]}',
        base, limit, limit * 2, limit * 3, limit * 4, F.lower("c_mktsegment"),
    )
    broken = {
        1: F.lit('{"limite_antiguedad":{"pendiente_dias":30}}'),
        2: F.concat(F.lit('{"moneda_base":"  ","politicas":{"tenant":'), key, F.lit("}}")),
        3: F.concat(F.lit("["), key, F.lit("]")),
        4: F.concat(F.lit('{"policies":'), good, F.lit("}")),
        5: F.replace(good, F.lit('"reglas_centro_costo"'), F.lit('"extra":1,"reglas_centro_costo"')),
        6: F.replace(good, F.lit('"aprobado_hasta":'), F.lit('"aprobado_hasta":-')),
        7: F.replace(good, F.lit('"categoria_prohibida":"food"'), F.lit('"categoria_prohibida":7,"nota":"x"')),
        8: F.concat(F.lit('{"moneda_base":'), key, F.lit(',"politicas":[]}')),
        9: F.concat(F.lit('{"moneda_base": "USD"'), key),
    }
    kind = F.pmod("c_custkey", F.lit(12))
    document = F.when(kind == 1, broken[1])
    for i in range(2, 10):
        document = document.when(kind == i, broken[i])
    return customers.select(
        "c_custkey", F.concat(F.lit("T"), key).alias("name"), kind.alias("kind"), document.otherwise(good).alias("policies")
    )


def _by_kind(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("kind", *columns).agg(F.count("*").alias("documents"))


def _parsed_documents(spark, sf_dir) -> DataFrame:
    """The documents with ``document``, the variant that the checks read."""
    return _documents(spark, sf_dir).withColumn("_raw", parsed(F.col("policies"))).withColumn("document", unwrap_policy(F.col("_raw"))).drop("_raw")


@query
def policy_shape(spark, sf_dir):
    rows = _parsed_documents(spark, sf_dir)
    return _by_kind(rows.select("kind", F.array_join(policy_errors(F.col("document")), ". ").alias("errors")), "errors")


@query
def policy_contract(spark, sf_dir):
    rows = _parsed_documents(spark, sf_dir)
    return _by_kind(rows.select("kind", F.array_join(policy_contract_errors(F.col("document")), "; ").alias("errors")), "errors")


@query
def policy_resolution(spark, sf_dir):
    """Explicit document, stored one, default text; and the base currency that follows."""
    rows = _documents(spark, sf_dir)
    explicit = F.when(F.col("kind") == 0, F.col("policies"))
    current = F.when(F.col("kind").isin(1, 5, 10), F.col("policies"))
    default = F.when(F.col("kind") == 2, F.lit("{not json")).when(F.col("kind") != 3, F.lit(json.dumps({"moneda_base": "CLP"})))
    chosen = resolved_policy(explicit, current, default)
    resolved = rows.withColumn("r", chosen)
    stored = F.get_json_object("r.policy", "$.moneda_base")
    return _by_kind(
        resolved.select(
            "kind",
            base_currency(stored, F.lit(None).cast("string"), F.lit("eur")).alias("base"),
            F.col("r.error").alias("error"),
        ),
        "base",
        "error",
    )


@query
def policy_upsert(spark, sf_dir):
    """Documents of the even tenants and of every third one replace or join those of the other two thirds."""
    rows = _parsed_documents(spark, sf_dir)
    # checked once for all readers, and where the documents were spread: a plain filter would go below that, into the few tasks of the scan
    fine = keep_where(rows, F.size(policy_errors(F.col("document"))) == 0).select("c_custkey", "name", F.to_json("document").alias("document"))
    fine = stage(fine, "fine-documents")
    at = lambda text: F.lit(text).cast("timestamp")
    existing = fine.where(F.col("c_custkey") % 3 != 0).select(
        "name", F.lit("{}").alias("policies"), at("2000-01-01 00:00:00").alias("created_at"), at("2000-01-01 00:00:00").alias("updated_at")
    )
    new = fine.where((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") % 3 == 0)).select("name", F.col("document").alias("policies"))
    saved = upsert_policies(existing, new, at("2001-01-01 00:00:00"))
    return saved.select(
        "name",
        F.get_json_object("policies", "$.moneda_base").alias("base"),
        _text_time("created_at").alias("created_at"),
        _text_time("updated_at").alias("updated_at"),
    )


@query
def tenant_policies(spark, sf_dir):
    """C-01 with a policy per row: each expense under the document of its employee, the default where that is unusable."""
    documents = _documents(spark, sf_dir).select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("empleado_id"), "policies")
    expenses = normalize_amount(_expenses(spark, sf_dir)).where(~F.col("negative_amount_detected"))
    judged = validate_tenants(expenses, documents, "empleado_id", "policies", STANDARD_POLICY, AS_OF)
    return judged.groupBy("policy_from", "status", "error").agg(
        F.count("*").alias("expenses"), F.sum(F.size("alertas")).alias("alerts")
    )


# ------------------------------------------------------------------- file names
@query
def safe_file_names(spark, sf_dir):
    return bridge.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", safe_name(F.col("url")).alias("safe_name"))


@query
def q_admissible_files(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(e) for e in (".csv", ".CSV", ".txt", ".csv.gz", ".Csv")]), (F.col("page_id") % 5 + 1).cast("int"))
    files = bridge.table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", F.concat(F.substring_index("url", "/", -1), ending).alias("filename")
    )
    return admissible_files(files)


# ------------------------------------------------------------------- streaming
def _streamed(spark, sf_dir, name: str, waves: Sequence[Callable[[str], None]], store: Store | None = None, enveloped: bool = True, policy=STANDARD_POLICY) -> Store:
    """Run each wave's lines (written under a folder) through one checkpoint: a later run resumes after the one before."""
    root = new_path(spark, name)
    store = store or Store(spark, f"{root}/store")
    stream = RecordStream(store, policy, RATES, AS_OF, process_seq=F.substring("process_id", 2, 9), enveloped=enveloped)
    for write in waves:
        write(f"{root}/events")
        stream.start(spark.readStream.text(f"{root}/events"), f"{root}/checkpoint", available_now=True).awaitTermination()
    return store


def _batch_wave(spark, sf_dir, low: int, high: int, enveloped: bool = False) -> Callable[[str], None]:
    space = workspace(spark, sf_dir)
    return lambda path: write_batch_events(space.records.where(F.col("process_seq").between(low, high)), space.columns, path, enveloped)


def _envelope_wave(spark, sf_dir, low: int, high: int, then: Callable[[], None] | None = None) -> Callable[[str], None]:
    """The same batch events, as envelopes."""

    def write(path: str) -> None:
        _batch_wave(spark, sf_dir, low, high, enveloped=True)(path)
        if then:
            then()

    return write


@query
def stream_outcomes(spark, sf_dir):
    """Batch events in two waves through one checkpoint; the second run resumes after the first."""
    store = _streamed(spark, sf_dir, "stream-outcomes", [_batch_wave(spark, sf_dir, low, low + 3) for low in (0, 4)], enveloped=False)
    return _flat_outcomes(store.read("outcomes"))


@query
def stream_tables(spark, sf_dir):
    """K-08: what the tables of a stream hold after two waves of envelopes, the last epoch of which is run again."""
    store = _streamed(spark, sf_dir, "stream-tables", [_envelope_wave(spark, sf_dir, low, low + 3) for low in (0, 4)])
    again = RecordStream(store, STANDARD_POLICY, RATES, AS_OF)
    again.run(spark.createDataFrame([("{}",)], "value string"), store.mark(again.name) - 1)

    def rows(name: str, kind: Column, amount: Column) -> DataFrame:
        table = store.read(name).groupBy(kind.alias("kind")).agg(F.count("*").alias("records"), F.sum(amount).cast("long").alias("tenths"))
        return table.select(F.lit(name).alias("table_name"), "kind", "records", "tenths")

    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    none = F.lit(None).cast("long")
    return (
        rows("expenses", F.col("validation_status"), tenths("monto_base"))
        .unionByName(rows("job_runs", F.concat_ws(":", "process_id", "status"), none))
        .unionByName(rows("job_run_stages", F.concat_ws(":", "stage", "status"), tenths("data.base_amount")))
        .unionByName(rows("outcomes", F.concat_ws(":", "process_id", "outcome"), tenths("base_amount")))
        .unionByName(rows("prints", F.substring("fingerprint", 1, 1), none))
    )


def _strange_letters(spark, sf_dir) -> DataFrame:
    """Per customer one line: a pattern that nobody handles, no pattern, no JSON, records that are no array, or a record that lacks fields."""
    customers = bridge.table(spark, sf_dir, "customer", "c_custkey")
    key = F.col("c_custkey").cast("string")
    kinds = [
        envelope("expense.deleted", F.concat(F.lit('{"id":'), key, F.lit("}"))),
        F.concat(F.lit('{"data":{"id":'), key, F.lit("}}")),
        F.concat(F.lit('{"pattern":"expense.batch","data":'), key),
        envelope(BATCH, F.concat(F.lit('{"processId":"X'), key, F.lit('","batchIndex":1,"records":{"id":"1"}}'))),
        envelope(RECORD_CREATED, F.concat(F.lit('{"id":"'), key, F.lit('","monto":"5"}'))),
    ]
    return customers.select(F.element_at(F.array(*kinds), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int")).alias("value"))


@query
def stream_redelivery(spark, sf_dir):
    """ST-3/S-04/P-09: single records, then batches, with strange envelopes among them; every line is delivered twice at once, and all again later."""
    space = workspace(spark, sf_dir)
    # without supplied amounts: which of several records of one fingerprint comes first then makes no difference
    raw = space.records.where("process_seq >= 4").select(envelope(RECORD_CREATED, F.to_json(F.struct(*bridge.COLUMNS))).alias("value"))

    def singles(path: str) -> None:
        lines = raw.unionByName(_strange_letters(spark, sf_dir))
        lines.unionByName(lines).write.mode("append").option("compression", "gzip").text(path)

    batch = _envelope_wave(spark, sf_dir, 0, 3)

    def both(path: str) -> None:
        batch(path)
        batch(path)
        singles(path)

    store = _streamed(spark, sf_dir, "stream-redelivery", [singles, both])
    runs = store.read("job_runs").groupBy(F.col("pattern").alias("kind"), F.col("status").alias("state")).agg(F.count("*").alias("records"))
    letters = store.read("letters_waiting").groupBy(F.col("reason").alias("kind"), F.concat(F.lit("intento "), F.col("attempts")).alias("state")).agg(F.count("*").alias("records"))
    dead = store.read("letters_dead").groupBy("reason", "attempts").agg(F.count("*").alias("records")).select(F.col("reason").alias("kind"), F.lit("muerta").alias("state"), "records")
    stored_rows = store.read("prints").agg(F.count_distinct("fingerprint").alias("records")).select(F.lit("prints").alias("kind"), F.lit("").alias("state"), "records")
    return runs.unionByName(letters).unionByName(dead).unionByName(stored_rows)


CHANGED_POLICY = STANDARD_POLICY | {
    "limite_antiguedad": {"pendiente_dias": 1200, "rechazado_dias": 2400},
    "limites_por_categoria": {"food": {"aprobado_hasta": 100, "pendiente_hasta": 150}},
    "reglas_centro_costo": [{"cost_center": "automobile", "categoria_prohibida": "software"}],
}


@query
def stream_policy_change(spark, sf_dir):
    """ST-5/J-10: the stored policy and rates are replaced between two waves; each wave comes under those in force when its epoch began."""
    store = Store(spark, new_path(spark, "stream-policies"))
    at = F.lit("2001-01-01 00:00:00").cast("timestamp")

    def keep(policy: dict, factor: float) -> None:
        document = spark.range(1).select(F.lit("current").alias("name"), F.lit(json.dumps(policy)).alias("policies"), at.alias("created_at"), at.alias("updated_at"))
        cells = [x for c, r in RATES.items() for x in (F.lit(c), F.lit(r * (1.0 if c == "USD" else factor)))]
        rates = spark.range(1).select(F.explode(F.create_map(*cells)).alias("currency", "rate"))
        with store.commit() as c:
            c.replace("validation_policies", document)
            c.replace("exchange_rates", rates.select("currency", F.lit("USD").alias("base"), F.lit(None).cast("string").alias("date"), "rate"))

    keep(STANDARD_POLICY, 1.0)
    first = _envelope_wave(spark, sf_dir, 0, 3)
    second = _envelope_wave(spark, sf_dir, 4, 7, then=lambda: keep(CHANGED_POLICY, 2.0))
    store = _streamed(spark, sf_dir, "stream-policy-change", [first, second], store, policy=None)
    done = store.read("outcomes").where(F.col("outcome") == "success")
    return done.groupBy("process_id", "validation_status").agg(
        F.count("*").alias("records"), F.sum(F.size("validation_alerts")).alias("alerts"), F.sum(F.round(F.col("base_amount") * 10).cast("long")).alias("tenths")
    )


@query
def stream_dedup_ttl(spark, sf_dir):
    store = Store(spark, new_path(spark, "stream-ttl"))
    events = (
        spark.readStream.schema(bridge.SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select("event_id", "ts", "user_id", "event_type")
    )
    stream = TtlStream(store, ["event_type", "user_id"], "ts", "event_id", 86_400)
    stream.start(events, f"{store.root}/checkpoint", available_now=True).awaitTermination()
    return store.read("marked").select("event_id", "event_type", "user_id", "mark")


@query
def stream_metrics(spark, sf_dir):
    space = workspace(spark, sf_dir)
    root = new_path(spark, "stream-metrics")
    outcomes = unpacked(spark.readStream.schema(space.stored_outcomes.schema).parquet(space.outcomes_path))
    metrics_stream(outcomes, f"{root}/metrics", f"{root}/checkpoint", available_now=True).awaitTermination()
    return read_metrics(spark, f"{root}/metrics")
