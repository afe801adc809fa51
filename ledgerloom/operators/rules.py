"""The rule engine as native column expressions.

A rule is a function ``(policy, expense) -> RuleResult``; ``evaluate`` takes an
ordered list of them, so user rules plug in beside the three standard ones.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import (
    APROBADO,
    CONFIG_CATEGORIA,
    LIMITE_ANTIGUEDAD,
    LIMITE_CATEGORIA,
    PENDIENTE,
    POLITICA_CENTRO_COSTO,
    RECHAZADO,
)
from ledgerloom.functions.dates import day_gap, days_since, local_day
from ledgerloom.functions.numbers import js_number
from ledgerloom.operators.policy import PolicyView
from ledgerloom.schemas import ALERT, ALERTS, SUGGESTIONS

log = logging.getLogger(__name__)

BAD_DATE = "Fecha de gasto inválida"
NO_BASE = "monto_base es requerido cuando moneda_original difiere de moneda_base"


@dataclass(frozen=True)
class Expense:
    """Columns a rule may read."""

    category: Column
    cost_center: Column
    amount: Column
    days: Column
    approved_limit: Column
    pending_limit: Column
    amount_text: Column
    approved_text: Column
    pending_text: Column
    pending_days_text: Column
    rejected_days_text: Column


@dataclass(frozen=True)
class RuleResult:
    status: Column
    alert: Column | None = None


@dataclass(frozen=True)
class Rule:
    """R-08/U-01"""

    name: str
    build: Callable[[PolicyView, Expense], RuleResult]


def alert(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("codigo"), message.alias("mensaje"))


def _age(policy: PolicyView, e: Expense) -> RuleResult:
    """R-01: limits are exclusive, the limit day itself is already beyond."""
    fresh = e.days < policy.pending_days
    waiting = e.days < policy.rejected_days

    def text(limit: Column, tail: str) -> Column:
        return alert(LIMITE_ANTIGUEDAD, F.concat(F.lit("Gasto excede los "), limit, F.lit(tail)))

    return RuleResult(
        F.when(fresh, F.lit(APROBADO)).when(waiting, F.lit(PENDIENTE)).otherwise(F.lit(RECHAZADO)),
        F.when(fresh, F.lit(None).cast(ALERT))
        .when(waiting, text(e.pending_days_text, " días. Requiere revisión."))
        .otherwise(text(e.rejected_days_text, " días.")),
    )


def _category(policy: PolicyView, e: Expense) -> RuleResult:
    """R-02/J-05: limits are inclusive; a category without limits is approved with an alert."""
    unknown = e.approved_limit.isNull()
    approved, pending = e.amount <= e.approved_limit, e.amount <= e.pending_limit
    amount = F.concat(e.amount_text, F.lit(" "), policy.base)
    no_limits = F.concat(
        F.lit("No existe configuración de límites para la categoría "),
        e.category,
        F.lit(", se aprueba por omisión."),
    )
    review = F.concat(
        F.lit("Requiere revisión: el monto "),
        amount,
        F.lit(" supera el umbral automático ("),
        e.approved_text,
        F.lit(") pero permanece por debajo del máximo ("),
        e.pending_text,
        F.lit(")."),
    )
    refused = F.concat(F.lit("El monto "), amount, F.lit(" excede el límite máximo ("), e.pending_text, F.lit(")."))
    return RuleResult(
        F.when(unknown | approved, F.lit(APROBADO)).when(pending, F.lit(PENDIENTE)).otherwise(F.lit(RECHAZADO)),
        F.when(unknown, alert(CONFIG_CATEGORIA, no_limits)).when(
            ~approved, alert(LIMITE_CATEGORIA, F.when(pending, review).otherwise(refused))
        ),
    )


def _cost_center(policy: PolicyView, e: Expense) -> RuleResult:
    """R-03/J-06: exact pair, case-sensitive."""
    hit = policy.forbidden(e.cost_center, e.category)
    return RuleResult(
        F.when(hit, F.lit(RECHAZADO)).otherwise(F.lit(APROBADO)),
        F.when(
            hit,
            alert(
                POLITICA_CENTRO_COSTO,
                F.concat(
                    F.lit("El C.C. '"),
                    e.cost_center,
                    F.lit("' no puede reportar '"),
                    e.category,
                    F.lit("'."),
                ),
            ),
        ),
    )


AGE = Rule("ExpenseAgeRule", _age)
CATEGORY = Rule("CategoryLimitRule", _category)
COST_CENTER = Rule("CostCenterRule", _cost_center)
STANDARD_RULES = (AGE, CATEGORY, COST_CENTER)


def fold_status(statuses: Sequence[Column]) -> Column:
    """R-04: the most severe one; PENDIENTE when no rule spoke."""
    if not statuses:
        return F.lit(PENDIENTE)
    any_of = lambda s: F.array_contains(F.array(*statuses), s)
    return F.when(any_of(RECHAZADO), RECHAZADO).when(any_of(PENDIENTE), PENDIENTE).otherwise(APROBADO)


def amount_for_rules(policy: PolicyView) -> Column:
    """F-18: the base amount, else the original one when the currencies are the same."""
    return F.coalesce(
        F.col("monto_base"),
        F.when(F.col("moneda_original") == policy.base, F.col("monto_original")),
    )


def evaluate(
    df: DataFrame,
    policy: PolicyView,
    as_of: datetime | date | None = None,
    tz: str = "UTC",
    rules: Sequence[Rule] = STANDARD_RULES,
    amount: Column | None = None,
    strict: bool = False,
    told: Column | None = None,
) -> DataFrame:
    """R-01..R-09/F-18/F-19: add amount, status, alertas, sugerencias and error.

    With ``told`` other rows get no texts and no alerts.

    A row that cannot be evaluated has ``error`` and no status; ``strict`` raises
    instead.  A rule that cannot be built is logged by name and aborts the plan.
    """
    today = local_day(as_of, tz)
    category = F.col("categoria")
    # shared inputs become columns, so no rule repeats their expressions
    df = df.withColumns(
        {
            "_amount": amount_for_rules(policy) if amount is None else amount,
            "_gap": day_gap(F.col("fecha"), today),
            "_approved": policy.approved_up_to(category),
            "_pending": policy.pending_up_to(category),
            "_pending_days": policy.pending_days,
            "_rejected_days": policy.rejected_days,
        }
    )
    if told is not None:
        df = df.withColumn("_told", told)
    only = (lambda c: c) if told is None else (lambda c: F.when(F.col("_told"), c))
    df = df.withColumns({"_days": days_since(F.col("_gap")), "_text": only(js_number("_amount"))})
    expense = Expense(
        category=category,
        cost_center=F.col("cost_center"),
        amount=F.col("_amount"),
        days=F.col("_days"),
        approved_limit=F.col("_approved"),
        pending_limit=F.col("_pending"),
        amount_text=F.col("_text"),
        approved_text=policy.approved_text(category) if policy.approved_text else js_number("_approved"),
        pending_text=policy.pending_text(category) if policy.pending_text else js_number("_pending"),
        pending_days_text=js_number("_pending_days") if policy.pending_days_text is None else policy.pending_days_text,
        rejected_days_text=js_number("_rejected_days")
        if policy.rejected_days_text is None
        else policy.rejected_days_text,
    )
    # statuses and alerts are separate columns, so whoever needs only the status builds no messages
    built: dict[str, Column] = {}
    for i, rule in enumerate(rules):
        try:
            result = rule.build(policy, expense)
        except Exception:
            log.error("Error evaluando regla %s", rule.name)
            raise
        built[f"_s{i}"] = result.status
        built[f"_a{i}"] = F.lit(None).cast(ALERT) if result.alert is None else only(result.alert)
    df = df.withColumns(built) if built else df
    statuses = [F.col(f"_s{i}") for i in range(len(rules))]
    alerts = [F.col(f"_a{i}") for i in range(len(rules))]
    suggestions = [
        F.struct(F.lit(r.name).alias("regla"), s.alias("estado")) for r, s in zip(rules, statuses, strict=True)
    ]
    problem = F.when(F.col("_amount").isNull(), F.lit(NO_BASE)).when(
        F.col("_days").isNull(), F.lit(BAD_DATE)
    )
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    df = df.withColumn("error", problem)
    good = F.col("error").isNull()
    return (
        df.withColumns(
            {
                "status": F.when(good, fold_status(statuses)),
                "alertas": F.when(good, F.array_compact(F.array(*alerts).cast(ALERTS))),
                "sugerencias": F.when(good, F.array(*suggestions).cast(SUGGESTIONS)),
            }
        )
        .withColumnRenamed("_amount", "monto_convertido")
        .withColumnRenamed("_days", "dias")
        .drop("_gap", "_text", "_approved", "_pending", "_pending_days", "_rejected_days", "_told", *built)
    )


def full_result(evaluated: DataFrame, policy: PolicyView) -> DataFrame:
    """R-07: the full result."""
    return evaluated.select(
        F.col("id").alias("gasto_id"),
        "status",
        "alertas",
        "sugerencias",
        F.col("monto_convertido").alias("montoConvertido"),
        policy.base.alias("monedaBase"),
    )


def short_response(evaluated: DataFrame) -> DataFrame:
    """R-07: the short response."""
    return evaluated.select(F.col("id").alias("gasto_id"), "status", "alertas")


def alert_rows(evaluated: DataFrame, *keep: str) -> DataFrame:
    """N-04: one row per alert.

    The outer form keeps Spark from testing the array for emptiness, with all rules
    in it, before the rules are computed.
    """
    return (
        evaluated.select(*keep, F.posexplode_outer("alertas").alias("orden", "alerta"))
        .where(F.col("alerta").isNotNull())
        .select(*keep, "orden", "alerta.codigo", "alerta.mensaje")
    )


def suggestion_rows(evaluated: DataFrame, *keep: str) -> DataFrame:
    """R-06: one row per rule."""
    return (
        evaluated.select(*keep, F.posexplode_outer("sugerencias").alias("orden", "s"))
        .where(F.col("s").isNotNull())
        .select(*keep, "orden", "s.regla", "s.estado")
    )


def alert_counts(evaluated: DataFrame, *by: str) -> DataFrame:
    """A-10"""
    return alert_rows(evaluated, *by, "status").groupBy(*by, "codigo", "status").agg(F.count("*").alias("alerts"))
