"""Policy documents: resolution, shape and contract checks, and use in rules."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import js_text
from ledgerloom.functions.text import trim
from ledgerloom.schemas import POLICY

_ROOT_KEYS = ("moneda_base", "limite_antiguedad", "limites_por_categoria", "reglas_centro_costo")


class PolicyError(ValueError):
    """A policy is absent or cannot be used."""


# ---------------------------------------------------------------- resolution
def parse_policy(text: str) -> dict[str, Any]:
    """F-27: malformed default text is an error of its own."""
    try:
        return json.loads(text)
    except ValueError as bad:
        raise PolicyError(
            "DEFAULT_POLICIES debe ser un JSON válido cuando se utiliza como fallback"
        ) from bad


def resolve_policy(
    explicit: Mapping[str, Any] | None = None,
    table: DataFrame | None = None,
    default_json: str | None = None,
) -> dict[str, Any]:
    """S-05: request, then the table row ``current``, then the default text."""
    if explicit is not None:
        return dict(explicit)
    if table is not None:
        row = table.where(F.col("name") == "current").select("policies").first()
        if row is not None:
            return json.loads(row.policies)
    if default_json and default_json.strip():
        return parse_policy(default_json)
    raise PolicyError("No se proporcionaron politicas y DEFAULT_POLICIES no está configurado")


def resolved_policy(explicit: Column, current: Column, default: Column) -> Column:
    """S-05/F-27 on columns of JSON text: ``struct<policy, error>``."""
    bad_default = default.isNotNull() & F.try_parse_json(default).isNull()
    chosen = F.coalesce(explicit, current, F.when(~bad_default, default))
    error = F.when(
        F.coalesce(explicit, current).isNull() & bad_default,
        F.lit("DEFAULT_POLICIES debe ser un JSON válido cuando se utiliza como fallback"),
    ).when(
        chosen.isNull(),
        F.lit("No se proporcionaron politicas y DEFAULT_POLICIES no está configurado"),
    )
    return F.struct(chosen.alias("policy"), error.alias("error"))


def base_currency(policy_base: Column, default_base: Column, own: Column) -> Column:
    """F-14: table policy, default policy, the row's own currency; upper-cased."""
    blank = F.lit("")
    return F.upper(
        F.coalesce(F.nullif(trim(policy_base), blank), F.nullif(trim(default_base), blank), own)
    )


# -------------------------------------------------------------------- checks
# All of them read a variant: a document is parsed once, into a column of its own (``parsed``).
NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def parsed(document: Column) -> Column:
    """The document as a variant; null for malformed text."""
    return F.try_parse_json(document)


def kind(variant: Column) -> Column:
    """OBJECT, ARRAY, STRING, DOUBLE, ... of a variant; null for null."""
    return F.regexp_extract(F.schema_of_variant(variant), "^([A-Z]+)", 1)


def _at(variant: Column, path: str, to: str = "variant") -> Column:
    return F.try_variant_get(variant, path, to)


def _is(variant: Column, *kinds: str) -> Column:
    return F.coalesce(kind(variant).isin(*kinds), F.lit(False))


def unwrap_policy(variant: Column) -> Column:
    """F-26: ``{"policies": {...}}`` becomes its content."""
    return F.when(_is(variant, "OBJECT"), F.coalesce(_at(variant, "$.policies"), variant)).otherwise(variant)


def policy_errors(variant: Column) -> Column:
    """F-24: messages of the shape check."""
    base = F.when(_is(_at(variant, "$.moneda_base"), "STRING"), trim(_at(variant, "$.moneda_base", "string")))
    lists = _at(variant, "$.politicas")
    found = F.array(
        F.when(F.coalesce(base, F.lit("")) == "", F.lit("Falta campo requerido: moneda_base (string)")),
        F.when(lists.isNotNull() & ~_is(lists, "ARRAY"), F.lit("Campo inválido: politicas debe ser un array")),
    )
    no_object = F.array(F.lit("policies debe ser un objeto JSON"))
    return F.when(~_is(variant, "OBJECT"), no_object).otherwise(F.array_compact(found))


def _unknown(variant: Column, allowed: tuple[str, ...]) -> Column:
    """Messages for keys of an object that are not allowed, in the order of the keys."""
    members = F.when(_is(variant, "OBJECT"), _at(variant, "$", "map<string,variant>"))
    keys = F.coalesce(F.map_keys(members), F.array().cast("array<string>"))
    extra = F.filter(F.array_sort(keys), lambda k: ~k.isin(*allowed))
    return F.transform(extra, lambda k: F.concat(F.lit("property "), k, F.lit(" should not exist")))


def _not_positive(variant: Column, *names: str) -> list[Column]:
    checks = []
    for n in names:
        value = F.when(_is(_at(variant, f"$.{n}"), *NUMBERS), _at(variant, f"$.{n}", "double"))
        checks.append(F.when(~F.coalesce(value > 0, F.lit(False)), F.lit(f"{n} must be a positive number")))
    return checks


def policy_contract_errors(variant: Column) -> Column:
    """F-25: the strict contract; every violation, root keys first."""
    age, limits, pairs = (_at(variant, f"$.{n}") for n in _ROOT_KEYS[1:])
    bounds, sides = ("aprobado_hasta", "pendiente_hasta"), ("cost_center", "categoria_prohibida")
    days = ("pendiente_dias", "rechazado_dias")

    def limit_errors(entry: Column) -> Column:
        found = F.array_compact(F.concat(F.array(*_not_positive(entry["value"], *bounds)), _unknown(entry["value"], bounds)))
        return F.transform(found, lambda m: F.concat(F.lit("limites_por_categoria."), entry["key"], F.lit("."), m))

    def pair_errors(pair: Column) -> Column:
        wrong = [F.when(~_is(_at(pair, f"$.{n}"), "STRING"), F.lit(f"reglas_centro_costo.{n} must be a string")) for n in sides]
        return F.concat(F.array_compact(F.array(*wrong)), _unknown(pair, sides))

    root = (("moneda_base", "STRING", "a string"), ("limites_por_categoria", "OBJECT", "an object"), ("reglas_centro_costo", "ARRAY", "an array"))
    wrong = [F.when(~_is(_at(variant, f"$.{n}"), k), F.lit(f"{n} must be {a}")) for n, k, a in root]
    each_limit = F.map_entries(F.when(_is(limits, "OBJECT"), _at(limits, "$", "map<string,variant>")))
    each_pair = F.when(_is(pairs, "ARRAY"), _at(pairs, "$", "array<variant>"))
    none = F.array().cast("array<string>")
    return F.concat(
        _unknown(variant, _ROOT_KEYS),
        F.array_compact(F.array(*wrong, *_not_positive(age, *days))),
        _unknown(age, days),
        F.coalesce(F.flatten(F.transform(each_limit, limit_errors)), none),
        F.coalesce(F.flatten(F.transform(each_pair, pair_errors)), none),
    )


def tenant_documents(documents: DataFrame, document: str, default: Mapping[str, Any]) -> DataFrame:
    """F-24..F-27 for a policy per row: ``document`` (JSON text) becomes the policy in force, with ``policy_from`` and ``policy_error``.

    A wrapped document is unwrapped. One that fails the shape check would not have been stored, so the default is in
    force (``policy_from`` is ``default``). One that has the shape but breaks the contract is in force, and every request under it is refused
    with ``policy_error``, its violations.
    """
    text = json.dumps(default)
    rows = documents.withColumn("_raw", parsed(F.col(document)))
    rows = rows.withColumn("_own", unwrap_policy(F.col("_raw"))).withColumn("_fits", F.size(policy_errors(F.col("_own"))) == 0)
    wrong = F.when(F.col("_fits"), F.array_join(policy_contract_errors(F.col("_own")), "; "))
    rows = rows.withColumns(
        {
            "policy_from": F.when(F.col("_fits"), F.lit("own")).otherwise(F.lit("default")),
            "policy_error": F.nullif(wrong, F.lit("")),
            document: F.when(F.col("_fits"), F.to_json("_own")).otherwise(F.lit(text)),
        }
    )
    return rows.drop("_raw", "_own", "_fits")


# ------------------------------------------------------------ use inside rules
@dataclass(frozen=True)
class PolicyView:
    """What the rules read from a policy, as columns; texts only where they are known beforehand."""

    base: Column
    pending_days: Column
    rejected_days: Column
    approved_up_to: Any
    pending_up_to: Any
    forbidden: Any
    approved_text: Any = None
    pending_text: Any = None
    pending_days_text: Any = None
    rejected_days_text: Any = None


def literal_policy(policy: Mapping[str, Any]) -> PolicyView:
    """A policy known when the plan is built: literals, no join."""
    limits = policy["limites_por_categoria"]
    pairs = {(p["cost_center"], p["categoria_prohibida"]) for p in policy["reglas_centro_costo"]}

    def table(field: str):
        cells = [F.lit(x) for cat, lim in limits.items() for x in (cat, float(lim[field]))]
        if not cells:
            return lambda category: F.lit(None).cast("double")
        return lambda category: F.try_element_at(F.create_map(*cells), category)

    def texts(field: str):
        cells = [F.lit(x) for cat, lim in limits.items() for x in (cat, js_text(lim[field]))]
        return lambda category: F.try_element_at(F.create_map(*cells), category) if cells else F.lit("")

    def forbidden(cost_center: Column, category: Column) -> Column:
        hit = F.lit(False)
        for cc, cat in sorted(pairs):
            hit = hit | ((cost_center == cc) & (category == cat))
        return hit

    age = policy["limite_antiguedad"]
    return PolicyView(
        base=F.lit(policy["moneda_base"]),
        pending_days=F.lit(float(age["pendiente_dias"])),
        rejected_days=F.lit(float(age["rechazado_dias"])),
        approved_up_to=table("aprobado_hasta"),
        pending_up_to=table("pendiente_hasta"),
        forbidden=forbidden,
        approved_text=texts("aprobado_hasta"),
        pending_text=texts("pendiente_hasta"),
        pending_days_text=F.lit(js_text(age["pendiente_dias"])),
        rejected_days_text=F.lit(js_text(age["rechazado_dias"])),
    )


def column_policy(policy: Column) -> PolicyView:
    """A policy that travels with the row: a struct column, or JSON text through ``from_json``."""
    limits = policy["limites_por_categoria"]
    return PolicyView(
        base=policy["moneda_base"],
        pending_days=policy["limite_antiguedad"]["pendiente_dias"],
        rejected_days=policy["limite_antiguedad"]["rechazado_dias"],
        approved_up_to=lambda category: F.try_element_at(limits, category)["aprobado_hasta"],
        pending_up_to=lambda category: F.try_element_at(limits, category)["pendiente_hasta"],
        forbidden=lambda cc, cat: F.coalesce(
            F.array_contains(
                policy["reglas_centro_costo"],
                F.struct(cc.alias("cost_center"), cat.alias("categoria_prohibida")),
            ),
            F.lit(False),
        ),
    )


def policy_struct(document: Column) -> Column:
    return F.from_json(document, POLICY)
