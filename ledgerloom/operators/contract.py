"""F-20: the strict contract an expense must meet before the rules see it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import real_date

TEXT_FIELDS = ("id", "empleado_id", "moneda_original", "categoria", "cost_center")


def _finite_positive(c: Column) -> Column:
    return (c > 0) & (c < float("inf"))


def contract_ok(amount: Column, base_amount: Column) -> Column:
    """The same contract as one predicate."""
    text = [F.col(f).isNotNull() for f in TEXT_FIELDS]
    return reduce(
        lambda a, b: a & b,
        [
            *text,
            F.coalesce(_finite_positive(amount), F.lit(False)),
            F.coalesce(_finite_positive(base_amount), F.lit(True)),
            real_date(F.col("fecha")).isNotNull(),
        ],
    )


def contract_errors(amount: Column, base_amount: Column) -> Column:
    """Messages of every violated clause, in field order."""
    fecha = F.col("fecha")
    checks = [
        F.when(F.col(f).isNull(), F.lit(f"{f} must be a string")) for f in TEXT_FIELDS[:2]
    ]
    checks.append(
        F.when(
            ~F.coalesce(_finite_positive(amount), F.lit(False)),
            F.lit("monto_original must be a positive number"),
        )
    )
    checks.append(F.when(F.col("moneda_original").isNull(), F.lit("moneda_original must be a string")))
    checks.append(
        F.when(
            base_amount.isNotNull() & ~_finite_positive(base_amount),
            F.lit("monto_base must be a positive number"),
        )
    )
    checks.append(
        F.when(
            ~F.coalesce(fecha.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
            F.lit("fecha debe tener el formato yyyy-mm-dd"),
        ).when(real_date(fecha).isNull(), F.lit("Fecha de gasto inválida"))
    )
    checks += [F.when(F.col(f).isNull(), F.lit(f"{f} must be a string")) for f in TEXT_FIELDS[3:]]
    return F.array_compact(F.array(*checks))
