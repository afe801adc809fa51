"""C-12: evaluate stored history again and compare with its recorded result."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import to_fixed2
from ledgerloom.functions.text import parse_result
from ledgerloom.operators.fx import attach_rate
from ledgerloom.operators.lookup import keep_where
from ledgerloom.operators.policy import literal_policy
from ledgerloom.operators.rules import evaluate
from ledgerloom.sources.files import RESULT_COLUMN, result_text


def historical_amount(base: str) -> Column:
    """F-36: two decimals after conversion; the base currency stays as it is."""
    return F.when(F.col("moneda_original") == base, F.col("monto_original")).otherwise(
        to_fixed2(F.col("_product"))
    )


def evaluate_history(
    expenses: DataFrame, policy: Mapping, rates: Mapping[str, float], as_of: datetime | date, tz: str = "UTC"
) -> DataFrame:
    view = literal_policy(policy)
    priced = attach_rate(expenses, rates, F.col("moneda_original"), view.base)
    priced = priced.withColumn("_product", F.col("monto_original") * F.col("rate"))
    return evaluate(priced, view, as_of, tz, amount=historical_amount(policy["moneda_base"])).drop("_product")


def with_results(evaluated: DataFrame) -> DataFrame:
    """K-07/F-21: append the result text."""
    return evaluated.withColumn(RESULT_COLUMN, result_text(F.col("status"), F.col("alertas")))


def mismatches(evaluated: DataFrame, first_only: bool = False) -> DataFrame:
    """C-12: rows whose stored result text differs from the fresh evaluation.

    Stored and fresh result sit on the same row, so nothing is joined.
    """
    expected = parse_result(F.col(RESULT_COLUMN), first_only)
    fresh = F.transform("alertas", lambda a: a["mensaje"])
    if first_only:
        fresh = F.slice(fresh, 1, 1)
    same = (F.col("expected.status") == F.col("status")) & (F.col("expected.alertas") == F.col("messages"))
    return keep_where(
        evaluated.withColumns({"expected": expected, "messages": fresh}), ~F.coalesce(same, F.lit(False))
    )


def regression(
    expenses: DataFrame,
    golden: DataFrame,
    policy: Mapping,
    rates: Mapping[str, float],
    as_of: datetime | date,
    key: str = "id",
) -> DataFrame:
    """C-12 with the golden column in a table of its own: join on ``key``, keep mismatches."""
    fresh = evaluate_history(expenses, policy, rates, as_of)
    return mismatches(fresh.join(golden.select(key, RESULT_COLUMN), key))
