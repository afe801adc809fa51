"""The star-schema sample tables seen as raw expense records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import spread

BATCH_SIZE = 500
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
COLUMNS = ["gasto_id", "empleado_id", "fecha", "monto", "moneda", "categoria", "empleado_cost_center"]
EXTRA = ["monto_base", "tipo_cambio"]


SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_type string",
    "pages": "page_id bigint, url string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A sample table under its known schema, so that opening it runs no job."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _category() -> Column:
    kind = F.substring_index("p_type", " ", 1)
    return (
        F.when(kind.isin("ECONOMY", "PROMO"), "food")
        .when(kind.isin("STANDARD", "SMALL"), "transport")
        .when(kind == "LARGE", "lodging")
        .otherwise("software")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each record, as narrow as they are stored, with its process.

    Customers meet the orders first, so the lines move once for their parts and once for their orders.
    """
    rows = table(
        spark, sf_dir, "lineitem", *ORDER, "l_returnflag", "l_linestatus", "l_shipdate", "l_discount"
    )
    rows = spread(rows, "l_orderkey", "l_linenumber", "l_partkey")
    negative = (
        (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    )
    rows = rows.withColumn("negative", negative).drop("l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_type").select("p_partkey", _category().alias("l_category"))
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    joined = rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.drop("p_partkey", "o_orderkey").withColumn("process_seq", F.pmod("l_orderkey", F.lit(8)).cast("int"))


def needed(numbered: DataFrame) -> DataFrame:
    """Numbered rows with what ``texts`` still reads; the rest of the order has done its work."""
    at = lambda n, c: F.when(F.col("l_linenumber") == n, F.col(c)).alias(c)
    rest = [c for c in numbered.columns if c not in ("l_partkey", "l_suppkey", "l_extendedprice", "l_discount")]
    return numbered.select(*rest, at(3, "l_extendedprice"), at(2, "l_discount"))


def texts(rows: DataFrame, quantity: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Text cells of each record with its process and the columns that order it; ``keep`` are columns to carry along."""
    quantity = F.col("l_quantity") if quantity is None else quantity
    currency = F.pmod("c_nationkey", F.lit(4))
    sign = F.when(F.col("negative"), F.lit(-1.0)).otherwise(F.lit(1.0))
    amount = sign * quantity * F.when(currency == 1, 3000.0).when(currency == 2, 60.0).otherwise(4.0)
    blank = F.lit("")
    given = ["process_seq", *[c for c in ORDER if c in rows.columns]]
    return rows.select(
        F.concat(F.lit("P"), F.col("process_seq").cast("string")).alias("process_id"),
        *given,
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("gasto_id"),
        F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("empleado_id"),
        F.col("l_shipdate").cast("date").cast("string").alias("fecha"),
        amount.cast("long").cast("string").alias("monto"),
        F.when(currency == 0, "USD").when(currency == 1, "CLP").when(currency == 2, "MXN").otherwise("EUR").alias("moneda"),
        F.col("l_category").alias("categoria"),
        F.when(F.col("c_mktsegment") == "BUILDING", "core_engineering")
        .otherwise(F.lower("c_mktsegment"))
        .alias("empleado_cost_center"),
        F.when(
            F.col("l_linenumber") == 3, F.translate(F.col("l_extendedprice").cast("string"), ".", ",")
        )
        .otherwise(blank)
        .alias("monto_base"),
        F.when(F.col("l_linenumber") == 2, (1 + F.col("l_discount")).cast("string")).otherwise(blank).alias("tipo_cambio"),
        *[c for c in dict.fromkeys(keep) if c not in given],
    )


def records(spark: SparkSession, sf_dir: str, quantity: Column | None = None) -> DataFrame:
    """Text cells of each record with its process and the columns that order it."""
    return texts(lines(spark, sf_dir), quantity)


def dated_tables(spark: SparkSession, sf_dir: str, rates: dict[str, float]) -> DataFrame:
    """One rate table per ship date: units of each currency for one USD, moved by the day of month."""
    days = table(spark, sf_dir, "lineitem", "l_shipdate").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    drift = 1 + F.dayofmonth("d") / 1000
    cells = []
    for currency, rate in rates.items():
        cells += [F.lit(currency), F.lit(1.0) if currency == "USD" else F.lit(1.0) / (F.lit(rate) * drift)]
    return days.select(
        F.col("d").cast("string").alias("date"),
        F.lit("USD").alias("base"),
        F.create_map(*cells).alias("rates"),
        F.col("d").cast("timestamp").alias("fetched_at"),
        F.lit(86_400).alias("ttl_seconds"),
    )


def dated_pairs(spark: SparkSession, sf_dir: str, rates: dict[str, float]) -> DataFrame:
    """Pair rates into USD per ship date: static rate x (1 + day of month / 1000)."""
    days = table(spark, sf_dir, "lineitem", "l_shipdate").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    cells = [x for cur, rate in rates.items() for x in (F.lit(cur), F.lit(rate) * (1 + F.dayofmonth("d") / 1000))]
    return days.select(
        F.explode(F.create_map(*cells)).alias("from_ccy", "rate"),
        F.lit("USD").alias("to_ccy"),
        F.col("d").cast("string").alias("date"),
        F.col("d").cast("timestamp").alias("fetched_at"),
        F.lit(86_400).alias("ttl_seconds"),
    ).where(F.col("from_ccy") != "USD")
