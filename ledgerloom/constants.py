"""Values that results are compared on."""

# --- fixed values: statuses and codes -------------------------------------
APROBADO = "APROBADO"
PENDIENTE = "PENDIENTE"
RECHAZADO = "RECHAZADO"

LIMITE_ANTIGUEDAD = "LIMITE_ANTIGUEDAD"
LIMITE_CATEGORIA = "LIMITE_CATEGORIA"
CONFIG_CATEGORIA = "CONFIG_CATEGORIA"
POLITICA_CENTRO_COSTO = "POLITICA_CENTRO_COSTO"

SUCCESS = "success"
FAILED = "failed"
SKIPPED = "skipped"
RUNNING = "running"

DUPLICATE = "duplicate_fingerprint"
DUPLICATE_DB = "duplicate_fingerprint_db"
NEGATIVE = "negative_amount"

PROCESANDO = "PROCESANDO"
COMPLETADO = "COMPLETADO"
ERROR = "ERROR"

STAGES = ("dedup", "normalize", "currency", "validation", "persist")

# --- fixed values: accepted column names, in priority order ----------------
ALIASES = {
    "id": ("id", "expense_id", "gasto_id"),
    "empleado_id": ("empleado_id", "employee_id", "empleado", "employee"),
    "fecha": ("fecha", "date", "fecha_gasto", "expense_date"),
    "monto_original": ("monto_original", "amount", "monto", "importe"),
    "moneda_original": ("moneda_original", "currency", "moneda", "currency_code"),
    "categoria": ("categoria", "category"),
    "cost_center": (
        "cost_center",
        "costcenter",
        "cost_center_id",
        "centro_costo",
        "empleado_cost_center",
    ),
    "monto_base": ("monto_base", "base_amount", "monto_clp"),
    "tipo_cambio": ("tipo_cambio", "exchange_rate", "tasa_cambio"),
}
REQUIRED = (
    "id",
    "empleado_id",
    "fecha",
    "monto_original",
    "moneda_original",
    "categoria",
    "cost_center",
)
NUMERIC = ("monto_original", "monto_base", "tipo_cambio")
FINGERPRINT_FIELDS = ("fecha", "monto_original", "moneda_original")

# --- fixed values: the standard policy and static rates to USD -------------
STANDARD_POLICY = {
    "moneda_base": "USD",
    "limite_antiguedad": {"pendiente_dias": 30, "rechazado_dias": 60},
    "limites_por_categoria": {
        "food": {"aprobado_hasta": 100, "pendiente_hasta": 150},
        "transport": {"aprobado_hasta": 200, "pendiente_hasta": 250},
    },
    "reglas_centro_costo": [
        {"cost_center": "core_engineering", "categoria_prohibida": "food"},
    ],
}
STATIC_RATES = {"USD": 1.0, "CLP": 0.0012, "MXN": 0.058, "EUR": 1.1}

# --- fixed values: characters removed by a text trim -----------------------
WHITESPACE = "".join(
    chr(c)
    for c in (9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)
)

DEDUP_TTL_SECONDS = 86_400
FX_TTL_SECONDS = 86_400
POLICY_TTL_SECONDS = 5
