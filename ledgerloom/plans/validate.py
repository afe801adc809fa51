"""C-01 and A-02: price, evaluate and count."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import APROBADO, PENDIENTE, RECHAZADO
from ledgerloom.operators.lookup import dimension_join
from ledgerloom.operators.policy import column_policy, literal_policy, policy_struct, tenant_documents
from ledgerloom.operators.rules import STANDARD_RULES, Rule, evaluate
from ledgerloom.plans.outcomes import normalize_amount, price
from ledgerloom.session import stage

STATUSES = [APROBADO, PENDIENTE, RECHAZADO]


def validate(
    expenses: DataFrame,
    policy: Mapping | str,
    as_of: datetime | date | None = None,
    tz: str = "UTC",
    rules: Sequence[Rule] = STANDARD_RULES,
    strict: bool = False,
) -> DataFrame:
    """C-01: ``policy`` is a document, or the name of a column of documents (JSON text)."""
    if isinstance(policy, str):
        carried = expenses.withColumn("_policy", policy_struct(F.col(policy)))
        return evaluate(carried, column_policy(F.col("_policy")), as_of, tz, rules, strict=strict).drop("_policy")
    return evaluate(expenses, literal_policy(policy), as_of, tz, rules, strict=strict)


def validate_tenants(
    expenses: DataFrame,
    documents: DataFrame,
    key: str,
    document: str,
    default: Mapping,
    as_of: datetime | date | None = None,
    tz: str = "UTC",
    rules: Sequence[Rule] = STANDARD_RULES,
) -> DataFrame:
    """C-01 under a policy per row: each expense under the document of its ``key``, all of them judged or refused.

    Documents are checked and parsed once each, before the join, and stored, since several joins read them. Expenses without a document, or whose document has not the shape
    of one, come under the default; those whose document breaks the contract are refused with its violations. A popular
    key is spread unless the documents are few enough to broadcast.
    """
    checked = tenant_documents(documents.select(key, F.col(document).alias("_policy")), "_policy", default)
    checked = stage(checked.withColumn("_policy", policy_struct(F.col("_policy"))), "tenant-documents")
    joined = dimension_join(expenses, checked, [key], [F.col("id"), F.col("fecha")])
    joined = joined.withColumns(
        {
            "_policy": F.coalesce("_policy", policy_struct(F.lit(json.dumps(default)))),
            "policy_from": F.coalesce("policy_from", F.lit("default")),
        }
    )
    judged = evaluate(joined, column_policy(F.col("_policy")), as_of, tz, rules).drop("_policy")
    refused = F.col("policy_error").isNotNull()
    none = {c: F.when(~refused, F.col(c)) for c in ("status", "alertas", "sugerencias")}
    return judged.withColumns(none | {"error": F.coalesce("policy_error", "error")}).drop("policy_error")


def validate_priced(
    expenses: DataFrame,
    policy: Mapping,
    rates: Mapping[str, float] | DataFrame,
    as_of: datetime | date | None = None,
    tz: str = "UTC",
    rules: Sequence[Rule] = STANDARD_RULES,
) -> DataFrame:
    """C-01 on the non-negative expenses after their conversion to the base currency."""
    positive = normalize_amount(expenses).where(~F.col("negative_amount_detected"))
    priced = price(positive, rates, policy["moneda_base"])
    return evaluate(priced, literal_policy(policy), as_of, tz, rules, amount=F.col("base_amount"))


def total_amount(amount: Column) -> Column:
    """The exact sum of amounts with one decimal; amounts beyond 28 digits are added as doubles."""
    exact = amount.try_cast("decimal(28,1)")
    beyond = F.sum(F.when(exact.isNull(), amount))
    return F.coalesce(F.sum(exact).cast("double") + beyond, F.sum(exact).cast("double"), beyond)


def status_breakdown(evaluated: DataFrame) -> DataFrame:
    """A-02"""
    return evaluated.groupBy("status").agg(
        F.count("*").alias("expenses"),
        total_amount(F.col("base_amount")).alias("total_base"),
    )


def status_by_process(evaluated: DataFrame) -> DataFrame:
    """A-02 per process, one column per status."""
    return evaluated.groupBy("process_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    )
