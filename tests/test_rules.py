from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.constants import STANDARD_POLICY
from ledgerloom.operators import rules
from ledgerloom.operators.policy import (
    PolicyError,
    literal_policy,
    parse_policy,
    resolve_policy,
)
from ledgerloom.plans.validate import validate

NOW = datetime(2025, 1, 10, tzinfo=timezone.utc)
TZ = "America/Santiago"
DDL = """id string, empleado_id string, fecha string, monto_original double, moneda_original string,
    categoria string, cost_center string, monto_base double"""

CASES = [
    ("2025-01-01", "food", "growth", 80.0, "APROBADO", []),
    ("2024-12-01", "food", "growth", 80.0, "PENDIENTE", ["Gasto excede los 30 días. Requiere revisión."]),
    ("2025-01-01", "food", "core_engineering", 80.0, "RECHAZADO", ["El C.C. 'core_engineering' no puede reportar 'food'."]),
    ("2024-09-01", "food", "growth", 200.0, "RECHAZADO",
     ["Gasto excede los 60 días.", "El monto 200 USD excede el límite máximo (150)."]),
    ("2024-12-05", "food", "growth", 140.5, "PENDIENTE",
     ["Gasto excede los 30 días. Requiere revisión.",
      "Requiere revisión: el monto 140.5 USD supera el umbral automático (100) pero permanece por debajo del máximo (150)."]),
    ("2025-01-05", "food", "growth", 100.0, "APROBADO", []),
    ("2025-01-05", "food", "growth", 100.1, "PENDIENTE", None),
    ("2025-01-05", "food", "growth", 150.0, "PENDIENTE", None),
    ("2025-01-05", "food", "growth", 150.1, "RECHAZADO", None),
    ("2024-12-10", "food", "growth", 80.0, "PENDIENTE", None),  # exactly 30 days
    ("2024-11-10", "food", "growth", 80.0, "RECHAZADO", ["Gasto excede los 60 días."]),  # exactly 60 days
    ("2030-01-01", "food", "growth", 80.0, "APROBADO", []),
    ("2025-01-05", "food", "Core_Engineering", 80.0, "APROBADO", []),
    ("2025-01-05", "lodging", "growth", 9e6, "APROBADO",
     ["No existe configuración de límites para la categoría lodging, se aprueba por omisión."]),
    ("2025-13-40", "food", "growth", 80.0, None, None),
]


def frame(spark, cases=CASES):
    return spark.createDataFrame(
        [(str(i), "e", c[0], c[3], "USD", c[1], c[2], c[3]) for i, c in enumerate(cases)], DDL
    )


@pytest.mark.parametrize("carried", [False, True])
def test_cases(spark, carried):
    df = frame(spark)
    if carried:
        judged = validate(df.withColumn("p", F.lit(json.dumps(STANDARD_POLICY))), "p", NOW, TZ)
    else:
        judged = validate(df, STANDARD_POLICY, NOW, TZ)
    rows = {int(r.id): r for r in judged.collect()}
    for i, (*_, status, messages) in enumerate(CASES):
        assert rows[i].status == status, CASES[i]
        if messages is not None:
            assert [a.mensaje for a in rows[i].alertas] == messages
            assert [s.regla for s in rows[i].sugerencias] == ["ExpenseAgeRule", "CategoryLimitRule", "CostCenterRule"]
    assert rows[len(CASES) - 1].error == rules.BAD_DATE


def test_amount_resolution(spark):
    rows = [("a", "CLP", None), ("b", "CLP", 999.0), ("c", "USD", None)]
    df = spark.createDataFrame([(i, "e", "2025-01-05", 321.0, m, "software", "x", b) for i, m, b in rows], DDL)
    got = {r.id: (r.monto_convertido, r.error) for r in validate(df, STANDARD_POLICY, NOW).collect()}
    assert got == {"a": (None, rules.NO_BASE), "b": (999.0, None), "c": (321.0, None)}
    with pytest.raises(Exception, match="monto_base es requerido"):
        validate(df, STANDARD_POLICY, NOW, strict=True).select("error").collect()


def test_no_rules_is_pending_and_broken_rule_aborts(spark, caplog):
    assert {r.status for r in validate(frame(spark, CASES[:1]), STANDARD_POLICY, NOW, rules=[]).collect()} == {"PENDIENTE"}

    def broken(policy, e):
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError):
        validate(frame(spark), STANDARD_POLICY, NOW, rules=[rules.Rule("Broken", broken)])
    assert "Broken" in caplog.text


def test_shapes(spark):
    judged = validate(frame(spark, CASES[:1]), STANDARD_POLICY, NOW)
    view = literal_policy(STANDARD_POLICY)
    assert rules.full_result(judged, view).columns == ["gasto_id", "status", "alertas", "sugerencias", "montoConvertido", "monedaBase"]
    assert rules.short_response(judged).columns == ["gasto_id", "status", "alertas"]


def test_status_never_falls_with_amount_or_age(spark):
    order = {"APROBADO": 0, "PENDIENTE": 1, "RECHAZADO": 2}
    amounts = [(f"2025-01-05", "food", "growth", float(a), None, None) for a in range(80, 170, 3)]
    got = sorted((r.monto_original, order[r.status]) for r in validate(frame(spark, amounts), STANDARD_POLICY, NOW).collect())
    assert [s for _, s in got] == sorted(s for _, s in got)


def test_resolution(spark):
    table = spark.createDataFrame([("current", '{"moneda_base":"EUR"}')], "name string, policies string")
    assert resolve_policy({"moneda_base": "X"}, table) == {"moneda_base": "X"}
    assert resolve_policy(None, table)["moneda_base"] == "EUR"
    assert resolve_policy(None, table.where("false"), '{"moneda_base":"CLP"}')["moneda_base"] == "CLP"
    with pytest.raises(PolicyError, match="No se proporcionaron"):
        resolve_policy()
    with pytest.raises(PolicyError, match="JSON válido"):
        parse_policy("{oops")
