"""Schemas of the data model, as DDL text."""

from __future__ import annotations

POLICY = (
    "moneda_base string,"
    "limite_antiguedad struct<pendiente_dias:double,rechazado_dias:double>,"
    "limites_por_categoria map<string,struct<aprobado_hasta:double,pendiente_hasta:double>>,"
    "reglas_centro_costo array<struct<cost_center:string,categoria_prohibida:string>>"
)

CANONICAL = (
    "process_id string, process_seq int, batch_index int, record_index int, created_at timestamp,"
    "id string, empleado_id string, fecha string, monto_original double, moneda_original string,"
    "categoria string, cost_center string, monto_base double, tipo_cambio double, csv_row string"
)

RATES = (
    "date string, base string, currency string, rate double, fetched_at timestamp, ttl_seconds int"
)
RATE_TABLES = (
    "date string, base string, rates map<string,double>, fetched_at timestamp, ttl_seconds int"
)

ALERT = "struct<codigo:string,mensaje:string>"
ALERTS = f"array<{ALERT}>"
SUGGESTIONS = "array<struct<regla:string,estado:string>>"
