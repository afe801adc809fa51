"""Exchange rates: sources, lookup, conversion, listing and purge."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import dimension_join
from ledgerloom.schemas import RATES
from ledgerloom.session import stage

LATEST = "latest"
NO_RATE = "No existe tipo de cambio"

# U-02: a provider yields the rate table of a session
Provider = Callable[[SparkSession], DataFrame]


def rates_from_map(spark: SparkSession, rates: Mapping[str, float], base: str) -> DataFrame:
    """S-06: a static list as a long table without dates; such a rate answers any date."""
    rows = [(None, base, cur, float(rate), None, None) for cur, rate in rates.items()]
    return spark.createDataFrame(rows, RATES)


def static_provider(rates: Mapping[str, float], base: str) -> Provider:
    return lambda spark: rates_from_map(spark, rates, base)


def table_provider(path: str) -> Provider:
    return lambda spark: rates_from_tables(spark.read.parquet(path))


def rates_from_tables(tables: DataFrame) -> DataFrame:
    """S-07/N-05: one row per (date, currency) out of per-date maps."""
    return tables.select(
        "date", "base", F.explode("rates").alias("currency", "rate"), "fetched_at", "ttl_seconds"
    )


def live(rates: DataFrame, as_of: Column | datetime) -> DataFrame:
    """P-08: entries still inside their time to live."""
    return rates.where(F.lit(as_of) < _end())


def cross_rates(rates: DataFrame, to: str) -> DataFrame:
    """J-04: pairs (from, to, date) through the table's own base: rates[to] / rates[from]."""
    target = rates.where(F.upper("currency") == to.upper()).select(F.col("date").alias("_day"), F.col("rate").alias("_to"))
    return (
        rates.join(target, F.col("date").eqNullSafe(F.col("_day")))
        .where(F.col("rate") != 0)
        .select(
            F.upper("currency").alias("from_ccy"),
            F.lit(to.upper()).alias("to_ccy"),
            "date",
            (F.col("_to") / F.col("rate")).alias("rate"),
            *[c for c in ("fetched_at", "ttl_seconds") if c in rates.columns],
        )
    )


def pair_rates(rates: DataFrame) -> DataFrame:
    """A long table whose rate already leads from ``currency`` to ``base``."""
    return rates.select(
        F.upper("currency").alias("from_ccy"),
        F.upper("base").alias("to_ccy"),
        "date",
        "rate",
        *[c for c in ("fetched_at", "ttl_seconds") if c in rates.columns],
    )


def usable_pairs(pairs: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
    """One rate per (from, to, date): positive and finite, alive at ``as_of`` if given, the newest fetched."""
    if as_of is not None and {"fetched_at", "ttl_seconds"} <= set(pairs.columns):
        pairs = pairs.where(F.coalesce(F.lit(as_of) < _end(), F.lit(True)))
    keys = ["from_ccy", "to_ccy", "date"]
    pairs = pairs.where((F.col("rate") > 0) & (F.col("rate") < float("inf")))
    at = F.col("fetched_at") if "fetched_at" in pairs.columns else F.lit(None).cast("timestamp")
    newest = F.max(F.struct(at.alias("at"), "rate"))["rate"]
    return pairs.groupBy(*keys).agg(newest.alias("rate"))


def _end() -> Column:
    return F.timestamp_add("SECOND", F.col("ttl_seconds"), F.col("fetched_at"))


def identity(from_ccy: Column, to_ccy: Column) -> Column:
    """F-15: nothing to convert."""
    return (from_ccy == "") | (from_ccy == to_ccy)


def attach_rate(
    df: DataFrame,
    rates: Mapping[str, float] | DataFrame,
    from_ccy: Column,
    to_ccy: Column,
    date: Column | None = None,
    as_of: Column | datetime | None = None,
) -> DataFrame:
    """J-03/F-15: add ``rate`` and ``rate_source``; no rate leaves both null.

    A mapping holds rates into the one base in use and becomes a literal.  A table
    of pairs is looked up by (from, to, date); a missing date means ``latest``.  Rows of
    the table without a date answer any date that has no row of its own.
    """
    from_ccy, to_ccy = F.upper(from_ccy), F.upper(to_ccy)
    same = identity(from_ccy, to_ccy)
    if isinstance(rates, Mapping):
        cells = [F.lit(x) for cur, rate in rates.items() for x in (cur.upper(), float(rate))]
        found = F.try_element_at(F.create_map(*cells), from_ccy) if cells else F.lit(None).cast("double")
        out = df.withColumn("_found", F.when(~same, found))
    else:
        keys = ["from_ccy", "to_ccy", "date"]
        when = F.lit(LATEST) if date is None else F.coalesce(F.trim(date), F.lit(LATEST))
        pairs = stage(usable_pairs(rates, as_of), "rates")
        dated = pairs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rate").alias("_dated"))
        keyed = df.withColumns({"_from_ccy": from_ccy, "_to_ccy": to_ccy, "_date": when})
        spread = [F.col(c) for c in df.columns[:6]]
        out = dimension_join(keyed, dated.where("_date is not null"), [f"_{k}" for k in keys], spread)
        anytime = dated.where("_date is null").select("_from_ccy", "_to_ccy", F.col("_dated").alias("_anytime"))
        out = dimension_join(out, anytime, ["_from_ccy", "_to_ccy"], spread)
        out = out.withColumn("_found", F.coalesce("_dated", "_anytime")).drop(*[f"_{k}" for k in keys], "_dated", "_anytime")
    return out.withColumns(
        {
            "rate": F.when(same, F.lit(1.0)).otherwise(F.col("_found")),
            "rate_source": F.when(same, F.lit("cache")).when(F.col("_found").isNotNull(), F.lit("api")),
        }
    ).drop("_found")


def convert(
    items: DataFrame,
    rates: Mapping[str, float] | DataFrame,
    base: str = "USD",
    as_of: Column | datetime | None = None,
) -> DataFrame:
    """C-02: convert every item; its own ``moneda_base`` and ``fecha`` come first.  No rounding."""
    own = F.col("moneda_base") if "moneda_base" in items.columns else F.lit(None).cast("string")
    date = F.col("fecha") if "fecha" in items.columns else None
    to = F.upper(F.coalesce(own, F.lit(base)))
    priced = attach_rate(items.withColumn("_to", to), rates, F.col("moneda_original"), F.col("_to"), date, as_of)
    same = identity(F.upper("moneda_original"), F.col("_to"))
    return priced.withColumns(
        {
            "moneda_original": F.upper("moneda_original"),
            "moneda_base": F.col("_to"),
            "monto_convertido": F.col("monto_original") * F.col("rate"),
            "tipo_cambio": F.col("rate"),
            "rate_source": F.when(~same, F.col("rate_source")),
            "error": F.when(F.col("rate").isNull(), F.lit(NO_RATE)),
        }
    ).drop("_to", "rate")


def effective_rate(supplied: Column, rate: Column, base_amount: Column, amount: Column) -> Column:
    """F-16: what is recorded; a supplied rate wins but does not drive the base amount."""
    implied = F.when(amount != 0, base_amount / amount)
    return F.coalesce(supplied, rate, F.when(F.abs(implied) < float("inf"), implied))


def pairs_needed(df: DataFrame, base: str) -> DataFrame:
    """C-13: each (from, to, date) a run needs, once; identities need none."""
    return (
        df.select(
            F.upper("moneda_original").alias("from_ccy"),
            F.lit(base.upper()).alias("to_ccy"),
            F.coalesce("fecha", F.lit(LATEST)).alias("date"),
        )
        .where(~identity(F.col("from_ccy"), F.col("to_ccy")))
        .distinct()
    )


def materialize_pairs(needed: DataFrame, rates: DataFrame) -> DataFrame:
    """C-13: resolve the needed pairs once, ready for ``attach_rate``."""
    return needed.join(rates, ["from_ccy", "to_ccy", "date"], "left")


# ------------------------------------------------------------ listing and purge
LIST_ROWS, LIST_CAP = 200, 2000


def listing(entries: DataFrame, limit: int = LIST_ROWS) -> DataFrame:
    """P-07/L-06: the first entries by key; 200 unless told otherwise, 2000 at most."""
    return entries.orderBy("key").limit(max(1, min(limit, LIST_CAP)))


def live_entries(
    pairs: DataFrame,
    tables: DataFrame,
    as_of: Column | datetime,
    kind: str = "all",
    date: str | None = None,
) -> DataFrame:
    """P-07/N-06/F-38: both kinds of entries that are alive at ``as_of``, malformed ones dropped."""
    remaining = (
        F.unix_timestamp("fetched_at") + F.col("ttl_seconds") - F.unix_timestamp(F.lit(as_of))
    ).alias("ttl_left")
    parts = []
    if kind in ("all", "fx"):
        parts.append(
            pairs.where(
                F.col("rate").isNotNull()
                & F.col("fetched_at").isNotNull()
                & (F.coalesce("from_ccy", F.lit("")) != "")
                & (F.coalesce("to_ccy", F.lit("")) != "")
            ).select(
                F.concat_ws(":", F.lit("fx"), "from_ccy", "to_ccy", "date").alias("key"),
                F.lit("fx").alias("prefix"),
                "date",
                "from_ccy",
                "to_ccy",
                "rate",
                "fetched_at",
                remaining,
            )
        )
    if kind in ("all", "fx_table"):
        parts.append(
            tables.where(
                (F.coalesce("base", F.lit("")) != "") & F.col("rates").isNotNull() & F.col("fetched_at").isNotNull()
            ).select(
                F.concat_ws(":", F.lit("fx_table"), "date").alias("key"),
                F.lit("fx_table").alias("prefix"),
                "date",
                "base",
                F.size(F.map_keys("rates")).alias("currencies"),
                "fetched_at",
                remaining,
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    out = out.where(F.col("ttl_left") > 0)
    return out.where(F.col("date") == date) if date else out


def purge(entries: DataFrame, kind: str = "all", date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """C-11/A-09: (entries that stay, one-row count of the purged ones)."""
    hit = F.lit(True)
    if kind != "all":
        hit = hit & (F.col("prefix") == kind)
    if date:
        hit = hit & (F.col("date") == date)
    removed = entries.where(hit).agg(F.count("*").alias("deleted"))
    return entries.where(~F.coalesce(hit, F.lit(False))), removed
