"""The same questions in SQL, written against the sample tables alone."""

from __future__ import annotations

BASE = """
base AS (
  SELECT 'P' || CAST(l_orderkey % 8 AS VARCHAR) AS process_id, CAST(l_orderkey % 8 AS INTEGER) AS process_seq,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
    'G' || l_orderkey || '-' || l_linenumber AS id, 'E' || o_custkey AS empleado_id, o_custkey,
    strftime(l_shipdate, '%Y-%m-%d') AS fecha,
    CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CLP' WHEN 2 THEN 'MXN' ELSE 'EUR' END AS moneda,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber = 1 THEN -1e0 ELSE 1e0 END AS sgn,
    CASE c_nationkey % 4 WHEN 1 THEN 3000e0 WHEN 2 THEN 60e0 ELSE 4e0 END AS unit,
    CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'food' WHEN 'PROMO' THEN 'food'
      WHEN 'STANDARD' THEN 'transport' WHEN 'SMALL' THEN 'transport'
      WHEN 'LARGE' THEN 'lodging' ELSE 'software' END AS categoria,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'core_engineering' ELSE lower(c_mktsegment) END AS cost_center,
    CASE WHEN l_linenumber = 3 THEN l_extendedprice END AS given_base,
    CASE WHEN l_linenumber = 2 THEN 1 + l_discount END AS given_rate,
    CASE c_nationkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN CAST('0.0012' AS DOUBLE) WHEN 2 THEN CAST('0.058' AS DOUBLE)
      ELSE CAST('1.1' AS DOUBLE) END AS static_rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey
), raw AS (SELECT *, sgn * l_quantity * unit AS monto FROM base)"""

# non-negative rows priced with the static rates, without supplied amounts
PRICED = (
    BASE
    + """,
priced AS (
  SELECT *, floor(monto * static_rate * 10 + 0.5) / 10 AS amount,
    greatest(0, date_diff('day', CAST(fecha AS DATE), DATE '2001-01-01')) AS days
  FROM raw WHERE monto >= 0
)"""
)


def num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def judged(source: str, amount: str) -> str:
    """Three rule statuses and messages per row of ``source``."""
    text = num(amount)
    return f"""
judged AS (
  SELECT *,
    CASE WHEN days < 30 THEN 0 WHEN days < 60 THEN 1 ELSE 2 END AS s1,
    CASE WHEN days < 30 THEN NULL WHEN days < 60 THEN 'Gasto excede los 30 días. Requiere revisión.'
      ELSE 'Gasto excede los 60 días.' END AS m1,
    CASE WHEN lim1 IS NULL OR {amount} <= lim1 THEN 0 WHEN {amount} <= lim2 THEN 1 ELSE 2 END AS s2,
    CASE WHEN lim1 IS NULL THEN 'CONFIG_CATEGORIA' WHEN {amount} > lim1 THEN 'LIMITE_CATEGORIA' END AS c2,
    CASE WHEN lim1 IS NULL THEN 'No existe configuración de límites para la categoría ' || categoria || ', se aprueba por omisión.'
      WHEN {amount} <= lim1 THEN NULL
      WHEN {amount} <= lim2 THEN 'Requiere revisión: el monto ' || {text} || ' USD supera el umbral automático (' || lim1 ||
        ') pero permanece por debajo del máximo (' || lim2 || ').'
      ELSE 'El monto ' || {text} || ' USD excede el límite máximo (' || lim2 || ').' END AS m2,
    CASE WHEN cost_center = 'core_engineering' AND categoria = 'food' THEN 2 ELSE 0 END AS s3,
    CASE WHEN cost_center = 'core_engineering' AND categoria = 'food'
      THEN 'El C.C. ''' || cost_center || ''' no puede reportar ''' || categoria || '''.' END AS m3
  FROM (SELECT *, CASE categoria WHEN 'food' THEN 100 WHEN 'transport' THEN 200 END AS lim1,
      CASE categoria WHEN 'food' THEN 150 WHEN 'transport' THEN 250 END AS lim2 FROM {source})
), folded AS (
  SELECT *, CASE greatest(s1, s2, s3) WHEN 0 THEN 'APROBADO' WHEN 1 THEN 'PENDIENTE' ELSE 'RECHAZADO' END AS status,
    concat_ws('||', m1, m2, m3) AS messages,
    (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT AS n_alerts
  FROM judged
)"""


FOLDED = PRICED + "," + judged("priced", "amount")

ESTADO = "CASE {0} WHEN 0 THEN 'APROBADO' WHEN 1 THEN 'PENDIENTE' ELSE 'RECHAZADO' END"

FINGERPRINT = (
    "sha256('{\"fecha\":\"' || fecha || '\",\"monto_original\":' || CAST(CAST(monto AS BIGINT) AS VARCHAR) "
    "|| ',\"moneda_original\":\"' || moneda || '\"}')"
)

# numbered records
NUMBERED = (
    BASE
    + f""",
numbered0 AS (
  SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice) AS seq
  FROM raw
), numbered AS (
  SELECT *, CAST((seq - 1) // 500 + 1 AS INTEGER) AS batch_index, CAST((seq - 1) % 500 + 1 AS INTEGER) AS record_index,
    sha256(process_id || '|' || ((seq - 1) // 500 + 1) || '|' || ((seq - 1) % 500 + 1)) AS job_id,
    {FINGERPRINT} AS fingerprint, TIMESTAMP '2001-01-01 00:00:00' + to_seconds(seq) AS created_at
  FROM numbered0
)"""
)

# outcome of every record; EUR has no rate
OUTCOMES = (
    NUMBERED
    + """,
assessed AS (
  SELECT *, CASE WHEN given_base IS NOT NULL THEN floor(given_base * 10 + 0.5) / 10
      WHEN moneda <> 'EUR' THEN floor(abs(monto) * static_rate * 10 + 0.5) / 10 END AS amount,
    greatest(0, date_diff('day', CAST(fecha AS DATE), DATE '2001-01-01')) AS days
  FROM numbered
), firsts AS (
  SELECT *, seq = min(seq) OVER (PARTITION BY process_id, fingerprint) AS is_first FROM assessed
), verdicts AS (
  SELECT *, min(CASE WHEN is_first AND monto >= 0 AND amount IS NOT NULL THEN process_seq END)
      OVER (PARTITION BY fingerprint) AS first_process
  FROM firsts
), outcome0 AS (
  SELECT *, CASE WHEN first_process < process_seq THEN 'duplicate_fingerprint_db'
      WHEN NOT is_first THEN 'duplicate_fingerprint' WHEN monto < 0 THEN 'negative_amount'
      WHEN amount IS NULL THEN 'failed' ELSE 'success' END AS outcome,
    coalesce(given_rate, CASE WHEN given_base IS NULL AND moneda <> 'EUR' THEN static_rate END, amount / abs(monto)) AS eff_rate
  FROM verdicts
),"""
    + judged("outcome0", "amount")
    + """,
outcomes AS (
  SELECT *, CASE WHEN outcome IN ('success', 'failed') THEN outcome ELSE 'skipped' END AS run_status,
    CASE WHEN outcome IN ('success', 'failed') THEN amount END AS base_amount,
    CASE WHEN outcome IN ('success', 'failed') THEN eff_rate END AS exchange_rate,
    CASE WHEN outcome = 'success' THEN status END AS validation_status,
    CASE WHEN outcome = 'success' THEN messages END AS ok_messages
  FROM folded
), stored AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY process_seq DESC, seq DESC) AS rn
    FROM outcomes WHERE outcome = 'success') WHERE rn = 1
)"""
)

FLAT = """SELECT job_id, id, fingerprint, outcome, run_status, base_amount, exchange_rate, validation_status,
  ok_messages AS messages, CASE WHEN outcome = 'failed' THEN 'currency' END AS failed_stage FROM outcomes"""

STAGE_ROWS = (
    OUTCOMES
    + """,
stages AS (
  SELECT job_id, process_id, 'dedup' AS stage, 1 AS stage_order,
    CASE WHEN outcome LIKE 'duplicate%' THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN outcome = 'duplicate_fingerprint_db' THEN 'db' END AS source, CAST(NULL AS VARCHAR) AS reason,
    CAST(NULL AS DOUBLE) AS base_amount, CAST(NULL AS INTEGER) AS alertas_count, CAST(NULL AS VARCHAR) AS error
  FROM outcomes
  UNION ALL
  SELECT job_id, process_id, 'normalize', 2, CASE WHEN outcome = 'negative_amount' THEN 'skipped' ELSE 'success' END, NULL,
    CASE WHEN outcome = 'negative_amount' THEN outcome END, NULL, NULL, NULL
  FROM outcomes WHERE outcome NOT LIKE 'duplicate%'
  UNION ALL
  SELECT job_id, process_id, 'currency', 3, CASE WHEN outcome = 'success' THEN 'success' ELSE 'running' END, NULL, NULL,
    CASE WHEN outcome = 'success' THEN amount END, NULL,
    CASE WHEN outcome = 'failed' THEN 'No existe tipo de cambio: EUR-USD' END
  FROM outcomes WHERE outcome IN ('success', 'failed')
  UNION ALL
  SELECT job_id, process_id, 'validation', 4, 'success', NULL, NULL, NULL, n_alerts, NULL FROM outcomes WHERE outcome = 'success'
  UNION ALL
  SELECT job_id, process_id, 'persist', 5, 'success', NULL, NULL, NULL, NULL, NULL FROM outcomes WHERE outcome = 'success'
)"""
)

BATCH_IDS = "batch_rows AS (SELECT process_id, batch_index, id FROM numbered)"

FX = """
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
cur(currency, r) AS (VALUES ('USD', CAST('1' AS DOUBLE)), ('CLP', CAST('0.0012' AS DOUBLE)), ('MXN', CAST('0.058' AS DOUBLE)),
  ('EUR', CAST('1.1' AS DOUBLE))),
pairs AS (SELECT currency AS from_ccy, 'USD' AS to_ccy, strftime(d, '%Y-%m-%d') AS date, d,
  r * (1 + day(d) / CAST(1000 AS DOUBLE)) AS rate FROM days, cur WHERE currency <> 'USD'),
tables AS (SELECT strftime(d, '%Y-%m-%d') AS date, d, currency,
  CASE WHEN currency = 'USD' THEN 1e0 ELSE 1e0 / (r * (1 + day(d) / CAST(1000 AS DOUBLE))) END AS rate FROM days, cur)"""

ENTRIES = (
    FX
    + """,
entries AS (
  SELECT 'fx:' || from_ccy || ':USD:' || date AS key, 'fx' AS prefix, date, from_ccy, to_ccy, rate, CAST(NULL AS VARCHAR) AS base,
    CAST(NULL AS INTEGER) AS currencies,
    CAST(epoch(CAST(d AS TIMESTAMP)) + 86400 - epoch(TIMESTAMP '1998-06-01 12:00:00') AS BIGINT) AS ttl_left
  FROM pairs
  UNION ALL
  SELECT DISTINCT 'fx_table:' || date, 'fx_table', date, NULL, NULL, NULL, 'USD', 4,
    CAST(epoch(CAST(d AS TIMESTAMP)) + 86400 - epoch(TIMESTAMP '1998-06-01 12:00:00') AS BIGINT)
  FROM tables
)"""
)

HISTORY = (
    BASE
    + """,
priced AS (
  SELECT *, CASE WHEN moneda = 'USD' THEN monto ELSE round(CAST(monto * static_rate AS DECIMAL(30, 8)), 2)::DOUBLE END AS amount,
    greatest(0, date_diff('day', CAST(fecha AS DATE), DATE '2001-01-01')) AS days,
    greatest(0, date_diff('day', CAST(fecha AS DATE), DATE '2000-11-20')) AS old_days
  FROM raw
),"""
    + judged("priced", "amount")
    + """,
results AS (SELECT *, status || '|' || CASE WHEN messages = '' THEN 'sin alertas' ELSE messages END AS resultado_validacion FROM folded)"""
)

# The documents as text, the same text as a JSON value, and what is wrong with it.
DOCUMENTS = """
texts AS (
  SELECT c_custkey, c_custkey % 12 AS kind, 'T' || c_custkey AS name, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 90 + 10 AS lim,
    lower(c_mktsegment) AS cc, CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CLP' WHEN 2 THEN ' mxn ' ELSE 'EUR' END AS base
  FROM customer
), good AS (
  SELECT *, '{"moneda_base":"' || base || '","limite_antiguedad":{"pendiente_dias":' || lim || ',"rechazado_dias":' || lim * 2 ||
    '},"limites_por_categoria":{"food":{"aprobado_hasta":' || lim * 3 || ',"pendiente_hasta":' || lim * 4 ||
    '}},"reglas_centro_costo":[{"cost_center":"' || cc || '","categoria_prohibida":"food"}]}' AS g FROM texts
), docs0 AS (
  SELECT *, CASE kind WHEN 1 THEN '{"limite_antiguedad":{"pendiente_dias":30}}'
    WHEN 2 THEN '{"moneda_base":"  ","politicas":{"tenant":' || k || '}}' WHEN 3 THEN '[' || k || ']' WHEN 4 THEN '{"policies":' || g || '}'
    WHEN 5 THEN replace(g, '"reglas_centro_costo"', '"extra":1,"reglas_centro_costo"')
    WHEN 6 THEN replace(g, '"aprobado_hasta":', '"aprobado_hasta":-')
    WHEN 7 THEN replace(g, '"categoria_prohibida":"food"', '"categoria_prohibida":7,"nota":"x"')
    WHEN 8 THEN '{"moneda_base":' || k || ',"politicas":[]}' WHEN 9 THEN '{"moneda_base": "USD"' || k ELSE g END AS policies FROM good
), values0 AS (SELECT *, TRY_CAST(policies AS JSON) AS whole FROM docs0
), docs AS (SELECT *, coalesce(CASE WHEN json_type(whole) = 'OBJECT' THEN json_extract(whole, '$.policies') END, whole) AS j FROM values0
), parts AS (
  SELECT *, coalesce(json_type(j), '') AS root, coalesce(json_type(j, '$.moneda_base'), '') AS base_type, coalesce(json_type(j, '$.limites_por_categoria'), '') AS limits_type,
    coalesce(json_type(j, '$.reglas_centro_costo'), '') AS pairs_type, coalesce(json_type(j, '$.limite_antiguedad'), '') AS age_type FROM docs
), checked AS (
  SELECT *, CASE WHEN root <> 'OBJECT' THEN 'policies debe ser un objeto JSON' ELSE array_to_string(list_filter([
      CASE WHEN base_type <> 'VARCHAR' OR trim(j ->> '$.moneda_base') = '' THEN 'Falta campo requerido: moneda_base (string)' END,
      CASE WHEN json_type(j, '$.politicas') <> 'ARRAY' THEN 'Campo inválido: politicas debe ser un array' END], lambda x: x IS NOT NULL), '. ') END AS shape,
    array_to_string(list_filter(
      list_transform(list_filter(CASE WHEN root = 'OBJECT' THEN list_sort(json_keys(j)) ELSE [] END, lambda n: n NOT IN ('moneda_base', 'limite_antiguedad', 'limites_por_categoria', 'reglas_centro_costo')),
        lambda n: 'property ' || n || ' should not exist')
      || [CASE WHEN base_type <> 'VARCHAR' THEN 'moneda_base must be a string' END, CASE WHEN limits_type <> 'OBJECT' THEN 'limites_por_categoria must be an object' END,
          CASE WHEN pairs_type <> 'ARRAY' THEN 'reglas_centro_costo must be an array' END]
      || list_transform(['pendiente_dias', 'rechazado_dias'], lambda n: CASE WHEN coalesce(TRY_CAST(json_extract(j, '$.limite_antiguedad.' || n) AS DOUBLE), 0) > 0
          AND json_type(j, '$.limite_antiguedad.' || n) <> 'VARCHAR' THEN NULL ELSE n || ' must be a positive number' END)
      || list_transform(list_filter(CASE WHEN age_type = 'OBJECT' THEN json_keys(j, '$.limite_antiguedad') ELSE [] END, lambda n: n NOT IN ('pendiente_dias', 'rechazado_dias')),
        lambda n: 'property ' || n || ' should not exist')
      || flatten(list_transform(CASE WHEN limits_type = 'OBJECT' THEN json_keys(j, '$.limites_por_categoria') ELSE [] END, lambda c: list_transform(['aprobado_hasta', 'pendiente_hasta'],
          lambda n: CASE WHEN coalesce(TRY_CAST(json_extract(j, '$.limites_por_categoria.' || c || '.' || n) AS DOUBLE), 0) > 0 THEN NULL
            ELSE 'limites_por_categoria.' || c || '.' || n || ' must be a positive number' END)))
      || flatten(list_transform(CASE WHEN pairs_type = 'ARRAY' THEN json_extract(j, '$.reglas_centro_costo[*]') ELSE [] END, lambda p:
          list_transform(['cost_center', 'categoria_prohibida'], lambda n: CASE WHEN coalesce(json_type(p, '$.' || n), '') <> 'VARCHAR' THEN 'reglas_centro_costo.' || n || ' must be a string' END)
          || list_transform(list_filter(json_keys(p), lambda n: n NOT IN ('cost_center', 'categoria_prohibida')), lambda n: 'property ' || n || ' should not exist'))),
      lambda x: x IS NOT NULL), '; ') AS contract
  FROM parts
)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _abort(rounds: int) -> str:
    """Cut and dedup unrolled; more rounds than the sample needs to settle."""
    parts = [
        NUMBERED.replace("THEN -1e0 ELSE 1e0 END AS sgn", "THEN -1e0 ELSE 1e0 END * CASE WHEN l_orderkey % 97 = 5 AND l_linenumber = 2 THEN 0 ELSE 1 END AS sgn"),
        "cut0 AS (SELECT CAST(NULL AS VARCHAR) AS process_id, CAST(NULL AS INTEGER) AS batch_index, CAST(NULL AS INTEGER) AS first_error WHERE FALSE)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"""cut{i} AS MATERIALIZED (
  SELECT process_id, batch_index, min(record_index) AS first_error FROM (
    SELECT n.process_id, n.batch_index, n.record_index, n.monto,
      n.seq = min(n.seq) OVER (PARTITION BY n.process_id, n.fingerprint) AS is_first
    FROM numbered n LEFT JOIN cut{i - 1} c ON n.process_id = c.process_id AND n.batch_index = c.batch_index
    WHERE c.first_error IS NULL OR n.record_index <= c.first_error)
  WHERE is_first AND monto = 0 GROUP BY 1, 2)"""
        )
    select = f"""SELECT n.process_id, n.batch_index, count(*) AS processed, min(c.first_error) AS first_error
FROM numbered n LEFT JOIN cut{rounds} c ON n.process_id = c.process_id AND n.batch_index = c.batch_index
WHERE c.first_error IS NULL OR n.record_index <= c.first_error GROUP BY 1, 2"""
    return _with(", ".join(parts), select)


def _rule(status: str, code: str, message: str, *by: str) -> str:
    names = ", ".join(by)
    return _with(
        FOLDED,
        f"""SELECT {names}, {ESTADO.format(status)} AS estado, {code} AS codigo, {message} AS mensaje, count(*) AS expenses
FROM folded GROUP BY {names}, estado, codigo, mensaje""",
    )


def _summary(select: str) -> str:
    return _with(
        OUTCOMES
        + """,
joined AS (
  SELECT o.*, coalesce(e.validation_status, o.validation_status, 'PENDIENTE') AS eff
  FROM outcomes o LEFT JOIN stored e ON e.job_id = o.job_id
)""",
        select,
    )


def _audit(condition: str) -> str:
    return _with(
        OUTCOMES,
        f"""SELECT o.job_id, o.id AS expense_id, o.fingerprint, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  o.outcome AS reason, e.fecha AS expense_fecha, e.moneda AS expense_moneda_original, abs(e.monto) AS expense_monto_original,
  e.validation_status AS expense_validation_status
FROM outcomes o LEFT JOIN stored e ON e.job_id = o.job_id
WHERE o.process_id = 'P3' AND {condition} ORDER BY o.created_at DESC, o.job_id LIMIT 500""",
    )


def _sizes(runs: str, stages: str, expenses: str, detached: str, batches: str, processes: str, more: str = "") -> str:
    return _with(
        STAGE_ROWS,
        f"""SELECT 'expenses' AS table_name, count(*) AS records, count(*) FILTER (WHERE {detached}) AS detached FROM stored WHERE {expenses}
UNION ALL SELECT 'job_runs', count(*), 0 FROM outcomes WHERE {runs}
UNION ALL SELECT 'job_run_stages', count(*), 0 FROM stages WHERE {stages}
UNION ALL SELECT 'file_process_batches', count(DISTINCT (process_id, batch_index)), 0 FROM outcomes WHERE {batches}
UNION ALL SELECT 'file_processes', count(DISTINCT process_id), 0 FROM outcomes WHERE {processes}{more}""",
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["status_breakdown"] = _with(
        FOLDED,
        "SELECT status, count(*) AS expenses, CAST(sum(CAST(amount AS DECIMAL(20,1))) AS DOUBLE) AS total_base FROM folded GROUP BY status",
    )
    q["status_by_process_pivot"] = _with(
        FOLDED,
        """SELECT process_id, count(*) FILTER (WHERE status = 'APROBADO') AS aprobado,
  count(*) FILTER (WHERE status = 'PENDIENTE') AS pendiente, count(*) FILTER (WHERE status = 'RECHAZADO') AS rechazado
FROM folded GROUP BY process_id""",
    )
    q["rule_age"] = _rule("s1", "CASE WHEN m1 IS NOT NULL THEN 'LIMITE_ANTIGUEDAD' END", "m1", "fecha")
    q["rule_category"] = _rule("s2", "c2", "m2", "categoria")
    q["rule_cost_center"] = _rule("s3", "CASE WHEN m3 IS NOT NULL THEN 'POLITICA_CENTRO_COSTO' END", "m3", "cost_center", "categoria")
    q["validation_alerts"] = _with(
        FOLDED,
        """SELECT process_id, id, empleado_id, 0 AS orden, 'LIMITE_ANTIGUEDAD' AS codigo, m1 AS mensaje FROM folded WHERE m1 IS NOT NULL
UNION ALL SELECT process_id, id, empleado_id, (m1 IS NOT NULL)::INT, c2, m2 FROM folded WHERE m2 IS NOT NULL
UNION ALL SELECT process_id, id, empleado_id, (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT, 'POLITICA_CENTRO_COSTO', m3 FROM folded WHERE m3 IS NOT NULL""",
    )
    q["rule_suggestions"] = _with(
        FOLDED,
        f"""SELECT process_id, orden, regla, estado, count(*) AS expenses FROM (
  SELECT process_id, 0 AS orden, 'ExpenseAgeRule' AS regla, {ESTADO.format('s1')} AS estado FROM folded
  UNION ALL SELECT process_id, 1, 'CategoryLimitRule', {ESTADO.format('s2')} FROM folded
  UNION ALL SELECT process_id, 2, 'CostCenterRule', {ESTADO.format('s3')} FROM folded) GROUP BY ALL""",
    )
    q["alert_counts"] = _with(
        FOLDED,
        """SELECT codigo, status, count(*) AS alerts FROM (
  SELECT 'LIMITE_ANTIGUEDAD' AS codigo, status FROM folded WHERE m1 IS NOT NULL
  UNION ALL SELECT c2, status FROM folded WHERE m2 IS NOT NULL
  UNION ALL SELECT 'POLITICA_CENTRO_COSTO', status FROM folded WHERE m3 IS NOT NULL) GROUP BY ALL""",
    )
    q["custom_rule"] = _with(
        FOLDED,
        """SELECT status, suggestions, "monedaBase", codes, count(*) AS expenses FROM (
  SELECT CASE greatest(s1, s2, s3, CASE WHEN amount % 50 = 0 THEN 1 ELSE 0 END) WHEN 0 THEN 'APROBADO' WHEN 1 THEN 'PENDIENTE'
      ELSE 'RECHAZADO' END AS status, 4 AS suggestions, 'USD' AS "monedaBase",
    concat_ws(',', CASE WHEN m1 IS NOT NULL THEN 'LIMITE_ANTIGUEDAD' END, c2, CASE WHEN m3 IS NOT NULL THEN 'POLITICA_CENTRO_COSTO' END,
      CASE WHEN amount % 50 = 0 THEN 'MONTO_REDONDO' END) AS codes
  FROM folded) GROUP BY ALL""",
    )
    q["parse_numbers"] = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN l_extendedprice
  WHEN 2 THEN l_extendedprice WHEN 6 THEN l_quantity * 100 WHEN 7 THEN -(l_quantity + 0.5) END AS amount FROM lineitem"""
    q["alias_mapping"] = _with(
        BASE,
        """SELECT process_id, id, empleado_id, fecha, monto AS monto_original, moneda AS moneda_original, categoria, cost_center FROM raw""",
    )
    q["missing_fields"] = _with(
        BASE,
        """SELECT process_id, missing, 'Registro inválido: faltan campos requeridos (' || replace(missing, ',', ', ') ||
  '). Columnas recibidas: id, gasto_id, Empleado_ID, FECHA, monto, moneda, categoria, empleado_cost_center' AS error, count(*) AS records
FROM (SELECT process_id, CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN 'fecha' WHEN 3 THEN 'monto_original,moneda_original' END AS missing FROM raw)
WHERE missing IS NOT NULL GROUP BY process_id, missing""",
    )
    q["fingerprints"] = _with(
        BASE,
        f"SELECT process_id, id, {FINGERPRINT} AS fingerprint, process_id || ':' || {FINGERPRINT} AS dedup_key FROM raw",
    )
    wide = FINGERPRINT.replace(
        """'\"}')""",
        """'\",\"empleado_id\":\"' || empleado_id || '\",\"categoria\":\"' || categoria || '\",\"cost_center\":\"' || cost_center || '\"}')""",
    )
    q["wide_fingerprint"] = _with(
        BASE,
        f"""SELECT process_id, count(*) AS repeated_prints, count(*) FILTER (WHERE lo <> hi) AS told_apart, min(lo) AS smallest_wide
FROM (SELECT process_id, {FINGERPRINT} AS f, count(*) AS n, min({wide}) AS lo, max({wide}) AS hi FROM raw GROUP BY 1, 2)
WHERE n > 1 GROUP BY process_id""",
    )
    ranked = NUMBERED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY process_id, fingerprint ORDER BY seq) AS rn FROM numbered)"""
    q["dedup_first_seen"] = _with(ranked, "SELECT process_id, batch_index, record_index, id, fingerprint FROM ranked WHERE rn = 1")
    q["dedup_skipped"] = _with(
        ranked,
        "SELECT process_id, batch_index, record_index, id, fingerprint, 'duplicate_fingerprint' AS reason FROM ranked WHERE rn > 1",
    )
    q["dedup_against_persisted"] = _with(
        ranked,
        """SELECT process_id, batch_index, record_index, id, CASE WHEN fingerprint IN (SELECT fingerprint FROM ranked WHERE process_seq = 0)
  THEN 'duplicate_fingerprint_db' ELSE 'duplicate_fingerprint' END AS reason FROM ranked
WHERE process_seq > 0 AND (rn > 1 OR fingerprint IN (SELECT fingerprint FROM ranked WHERE process_seq = 0))""",
    )
    q["not_yet_persisted"] = _with(
        ranked,
        """SELECT process_id, batch_index, record_index, fingerprint FROM ranked
WHERE process_seq > 0 AND fingerprint NOT IN (SELECT fingerprint FROM ranked WHERE process_seq = 0)""",
    )
    q["negative_skipped"] = _with(
        BASE,
        "SELECT process_id, id, fecha, monto AS monto_original, -monto AS monto_normalizado FROM raw WHERE monto < 0",
    )
    no_rate = "CASE WHEN {0} IS NULL THEN 'No existe tipo de cambio' END AS error"
    q["convert_pairs"] = _with(
        BASE + "," + FX,
        f"""SELECT process_id, id, fecha, moneda AS moneda_original, 'USD' AS moneda_base, abs(monto) * r AS monto_convertido, r AS tipo_cambio,
  {no_rate.format('r')}, CASE WHEN moneda <> 'USD' AND r IS NOT NULL THEN 'api' END AS rate_source
FROM (SELECT raw.*, CASE WHEN moneda = 'USD' THEN 1e0 WHEN moneda <> 'EUR' THEN p.rate END AS r
  FROM raw LEFT JOIN pairs p ON p.from_ccy = moneda AND p.date = fecha)""",
    )
    q["convert_cross_rates"] = _with(
        BASE
        + ","
        + FX
        + """,
quotients AS MATERIALIZED (
  SELECT t.date, t.currency, e.rate / t.rate AS r FROM tables t JOIN tables e ON e.date = t.date AND e.currency = 'EUR'),
rated AS (
  SELECT raw.*, CASE WHEN moneda = 'EUR' THEN 1e0 ELSE q.r END AS r FROM raw LEFT JOIN quotients q ON q.currency = moneda AND q.date = fecha)""",
        f"""SELECT process_id, id, fecha, moneda AS moneda_original, 'EUR' AS moneda_base, abs(monto) * r AS monto_convertido, r AS tipo_cambio,
  {no_rate.format('r')} FROM rated""",
    )
    q["effective_rates"] = _with(
        BASE,
        """SELECT process_id, id, fecha, monto AS monto_original, 'USD' AS base_currency, b AS base_amount,
  coalesce(given_rate, CASE WHEN given_base IS NULL THEN r END, b / abs(monto)) AS exchange_rate,
  CASE WHEN given_base IS NOT NULL THEN NULL WHEN moneda = 'USD' THEN 'cache' WHEN r IS NOT NULL THEN 'api' END AS rate_source
FROM (SELECT *, floor(coalesce(given_base, abs(monto) * r) * 10 + 0.5) / 10 AS b
  FROM (SELECT *, CASE WHEN moneda <> 'EUR' THEN static_rate END AS r FROM raw))""",
    )
    q["fx_pairs_needed"] = _with(
        BASE + "," + FX,
        """SELECT n.from_ccy, 'USD' AS to_ccy, n.date, p.rate FROM (SELECT DISTINCT moneda AS from_ccy, fecha AS date FROM raw WHERE moneda <> 'USD') n
LEFT JOIN pairs p ON p.from_ccy = n.from_ccy AND p.date = n.date AND p.from_ccy <> 'EUR'""",
    )
    q["fx_listing"] = _with(ENTRIES, "SELECT * FROM entries WHERE ttl_left > 0 ORDER BY key LIMIT 200")
    q["fx_live"] = _with(
        FX,
        """SELECT date, 'USD' AS base, currency, rate FROM tables
WHERE TIMESTAMP '1998-01-01 12:00:00' < CAST(d AS TIMESTAMP) + INTERVAL 86400 SECOND""",
    )
    q["fx_purged"] = _with(
        ENTRIES,
        """SELECT prefix, count(*) AS entries FROM entries WHERE ttl_left > 0 AND NOT (prefix = 'fx' AND date = '1998-06-01') GROUP BY prefix
UNION ALL SELECT 'deleted', count(*) FROM entries WHERE ttl_left > 0 AND prefix = 'fx' AND date = '1998-06-01'""",
    )
    q["contract_violations"] = _with(
        BASE,
        """SELECT moneda AS moneda_original, violations, CASE WHEN moneda <> 'USD' THEN 'monto_base es requerido cuando moneda_original difiere de moneda_base'
    WHEN l_linenumber >= 6 THEN 'Fecha de gasto inválida' END AS rule_error, count(*) AS records
FROM (SELECT *, concat_ws('. ', CASE WHEN l_quantity = 1 THEN 'monto_original must be a positive number' END,
    CASE WHEN floor((l_quantity - 1) * unit * static_rate * 10 + 0.5) = 0 THEN 'monto_base must be a positive number' END,
    CASE l_linenumber WHEN 6 THEN 'fecha debe tener el formato yyyy-mm-dd' WHEN 7 THEN 'Fecha de gasto inválida' END) AS violations
  FROM raw) GROUP BY ALL""",
    )
    q["batches"] = _with(
        NUMBERED,
        """SELECT process_id, batch_index, count(*) AS records, min(record_index) AS first_record, max(record_index) AS last_record,
  min(l_orderkey) AS first_order FROM numbered GROUP BY 1, 2""",
    )
    q["batch_metadata"] = _with(
        NUMBERED,
        """SELECT process_id, batch_index, CAST(count(*) AS INTEGER) AS record_count, string_agg(id, ',' ORDER BY record_index) AS expense_ids
FROM numbered GROUP BY 1, 2""",
    )
    q["ingest_progress"] = _with(
        NUMBERED,
        """SELECT process_id, batch_index, max(seq) AS total_records, batch_index AS published_batches FROM numbered GROUP BY 1, 2""",
    )
    q["file_totals"] = _with(
        NUMBERED,
        "SELECT process_id, count(*) AS total_records, max(batch_index) AS published_batches FROM numbered GROUP BY 1",
    )
    q["csv_ingest"] = _with(
        BASE,
        """SELECT process_id, moneda AS moneda_original, count(*) AS records, sum(monto) AS amount, TRUE AS completed FROM raw GROUP BY ALL""",
    )
    q["record_outcomes"] = _with(OUTCOMES, FLAT)
    q["stream_outcomes"] = q["record_outcomes"]
    tenths = "CAST(sum(CAST(round({0} * 10) AS BIGINT)) AS BIGINT)"
    q["stream_tables"] = _with(
        STAGE_ROWS,
        f"""SELECT 'expenses' AS table_name, validation_status AS kind, count(*) AS records, {tenths.format('base_amount')} AS tenths FROM stored GROUP BY 2
UNION ALL SELECT 'job_runs', process_id || ':' || run_status, count(*), NULL FROM outcomes GROUP BY 2
UNION ALL SELECT 'job_run_stages', stage || ':' || status, count(*), {tenths.format('base_amount')} FROM stages GROUP BY 2
UNION ALL SELECT 'outcomes', process_id || ':' || outcome, count(*), {tenths.format('base_amount')} FROM outcomes GROUP BY 2
UNION ALL SELECT 'prints', left(fingerprint, 1), count(*), NULL FROM (SELECT DISTINCT fingerprint FROM outcomes WHERE outcome = 'success') GROUP BY 2""",
    )
    # Single records come first and stand in one process; what they store is a stored duplicate in the batches after them.
    q["stream_redelivery"] = _with(
        OUTCOMES
        + """,
alone AS (SELECT DISTINCT id, empleado_id, fecha, monto, moneda, categoria, cost_center, fingerprint FROM assessed WHERE process_seq >= 4),
alone_ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY id) AS rn FROM alone),
alone_states AS (SELECT *, CASE WHEN rn > 1 OR monto < 0 THEN 'skipped' WHEN moneda = 'EUR' THEN 'failed' ELSE 'success' END AS state FROM alone_ranked),
kept AS (SELECT DISTINCT fingerprint FROM alone_states WHERE state = 'success'),
batch_firsts AS (SELECT a.*, a.seq = min(a.seq) OVER (PARTITION BY a.process_id, a.fingerprint) AS one, k.fingerprint IS NOT NULL AS known
  FROM assessed a LEFT JOIN kept k ON k.fingerprint = a.fingerprint WHERE process_seq < 4),
batch_turns AS (SELECT *, min(CASE WHEN one AND NOT known AND monto >= 0 AND amount IS NOT NULL THEN process_seq END) OVER (PARTITION BY fingerprint) AS first_turn FROM batch_firsts),
batch_states AS (SELECT *, CASE WHEN known OR first_turn < process_seq OR NOT one OR monto < 0 THEN 'skipped' WHEN amount IS NULL THEN 'failed' ELSE 'success' END AS state FROM batch_turns),
letters AS (SELECT c_custkey % 5 AS kind FROM customer)""",
        """SELECT 'expense.created' AS kind, state, count(*) AS records FROM alone_states GROUP BY state
UNION ALL SELECT 'expense.batch', state, count(*) FROM batch_states GROUP BY state
UNION ALL SELECT CASE WHEN kind = 4 THEN 'registro inválido' ELSE 'sin pattern' END, 'intento 2', count(*) FROM letters WHERE kind IN (1, 2, 4) GROUP BY 1
UNION ALL SELECT 'prints', '', count(DISTINCT fingerprint) FROM (SELECT fingerprint FROM alone_states WHERE state = 'success' UNION ALL SELECT fingerprint FROM batch_states WHERE state = 'success')""",
    )
    changed = (
        OUTCOMES.replace("WHEN moneda <> 'EUR' THEN floor(abs(monto) * static_rate * 10 + 0.5) / 10", "WHEN moneda <> 'EUR' THEN floor(abs(monto) * (static_rate * wave_factor) * 10 + 0.5) / 10")
        .replace("SELECT *, CAST((seq - 1) // 500", "SELECT *, CASE WHEN process_seq < 4 OR moneda = 'USD' THEN 1e0 ELSE 2e0 END AS wave_factor, CAST((seq - 1) // 500")
        .replace("days < 30", "days < CASE WHEN process_seq < 4 THEN 30 ELSE 1200 END")
        .replace("days < 60", "days < CASE WHEN process_seq < 4 THEN 60 ELSE 2400 END")
        .replace("WHEN 'transport' THEN 200", "WHEN 'transport' THEN CASE WHEN process_seq < 4 THEN 200 END")
        .replace("WHEN 'transport' THEN 250", "WHEN 'transport' THEN CASE WHEN process_seq < 4 THEN 250 END")
        .replace("cost_center = 'core_engineering' AND categoria = 'food'", "CASE WHEN process_seq < 4 THEN cost_center = 'core_engineering' AND categoria = 'food' ELSE cost_center = 'automobile' AND categoria = 'software' END")
    )
    q["stream_policy_change"] = _with(
        changed,
        f"""SELECT process_id, validation_status, count(*) AS records, CAST(sum(n_alerts) AS BIGINT) AS alerts, {tenths.format('base_amount')} AS tenths
FROM outcomes WHERE outcome = 'success' GROUP BY 1, 2""",
    )
    q["job_stages"] = _with(
        STAGE_ROWS,
        "SELECT job_id, stage, stage_order, status, source, reason, base_amount, alertas_count, error FROM stages",
    )
    q["expenses_upserted"] = _with(
        OUTCOMES,
        """SELECT id, job_id, fecha, monto AS monto_original, moneda AS moneda_original, base_amount AS monto_base, exchange_rate AS tipo_cambio,
  validation_status FROM stored""",
    )
    q["batch_abort"] = _abort(12)
    metrics = """count(*) FILTER (WHERE run_status = 'success') AS processed_records,
  count(*) FILTER (WHERE run_status = 'skipped') AS skipped_records,
  count(*) FILTER (WHERE run_status = 'success' AND eff = 'PENDIENTE') AS pending_records,
  count(*) FILTER (WHERE run_status = 'success' AND eff = 'RECHAZADO') AS rejected_records,
  count(*) FILTER (WHERE outcome = 'negative_amount') AS negative_records,
  count(*) FILTER (WHERE outcome LIKE 'duplicate%') AS duplicate_records"""
    q["process_summary"] = _summary(
        f"""SELECT process_id, process_id || '.csv' AS filename, 'COMPLETADO' AS status, count(*) AS total_records,
  max(batch_index) AS published_batches, {metrics},
  count(*) FILTER (WHERE run_status = 'success' AND eff = 'APROBADO') AS approved_records FROM joined GROUP BY process_id"""
    )
    q["stream_metrics"] = _summary(f"SELECT process_id, {metrics} FROM joined GROUP BY process_id")
    q["anomaly_summary"] = _with(
        OUTCOMES,
        """SELECT process_id, CASE WHEN outcome = 'negative_amount' THEN 'negative' ELSE outcome END AS anomaly, count(*) AS records,
  string_agg(id, ',' ORDER BY seq) FILTER (WHERE rk <= 3) AS examples
FROM (SELECT process_id, outcome, id, seq, row_number() OVER (PARTITION BY process_id, outcome ORDER BY seq) AS rk
  FROM outcomes WHERE run_status = 'skipped') GROUP BY 1, 2""",
    )
    q["audit_duplicates"] = _audit("o.outcome LIKE 'duplicate%'")
    q["audit_negatives"] = _audit("o.outcome = 'negative_amount'")
    q["report_rows"] = _with(
        OUTCOMES,
        """SELECT id, fecha, moneda, CASE WHEN stored_job THEN CAST(CAST(abs(monto) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(monto AS BIGINT) AS VARCHAR) END AS monto,
  categoria, cost_center, CASE run_status WHEN 'success' THEN coalesce(validation_status, 'PENDIENTE') WHEN 'failed' THEN 'ERROR' ELSE 'OMITIDO' END AS resultado
FROM (SELECT o.*, EXISTS (SELECT 1 FROM stored e WHERE e.job_id = o.job_id) AS stored_job FROM outcomes o WHERE o.process_id = 'P3')
ORDER BY created_at, job_id LIMIT 2000""",
    )
    q["jobs_page"] = _with(
        OUTCOMES,
        """SELECT job_id, id AS expense_id, run_status AS status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  coalesce(validation_status, run_status) AS display_status FROM outcomes WHERE run_status = 'success' AND process_id = 'P5'
ORDER BY outcomes.created_at DESC, job_id LIMIT 40 OFFSET 80""",
    )
    q["job_page_info"] = _with(
        OUTCOMES,
        """SELECT least(1000000, greatest(CAST(ceil(n / 200e0) AS BIGINT), 1)) AS page, 200 AS page_size, n AS total,
  greatest(CAST(ceil(n / 200e0) AS BIGINT), 1) AS total_pages, FALSE AS has_next, ceil(n / 200e0) > 1 AS has_previous
FROM (SELECT count(*) AS n FROM outcomes WHERE run_status = 'failed')
UNION ALL
SELECT least(2, greatest(CAST(ceil(n / 50e0) AS BIGINT), 1)), 50, n, greatest(CAST(ceil(n / 50e0) AS BIGINT), 1),
  least(2, ceil(n / 50e0)) < ceil(n / 50e0), least(2, ceil(n / 50e0)) > 1
FROM (SELECT count(*) AS n FROM outcomes WHERE validation_status = 'PENDIENTE' AND process_id = 'P2')""",
    )
    q["job_detail_stages"] = _with(
        STAGE_ROWS,
        """SELECT o.job_id, coalesce(any_value(o.validation_status), any_value(o.run_status)) AS display_status,
  string_agg(s.stage || ':' || s.status, '>' ORDER BY s.stage_order) AS stages
FROM outcomes o JOIN stages s ON s.job_id = o.job_id WHERE o.process_id = 'P2' GROUP BY o.job_id""",
    )
    q["process_list"] = _with(
        NUMBERED,
        """SELECT process_id, process_id || '.csv' AS filename, 'COMPLETADO' AS status, count(*) AS total_records,
  strftime(TIMESTAMP '2001-01-01 00:00:00' + to_minutes(any_value(process_seq)), '%Y-%m-%d %H:%M:%S') AS created_at
FROM numbered GROUP BY process_id ORDER BY process_id DESC LIMIT 5""",
    )
    q["process_batches"] = _with(
        NUMBERED,
        """SELECT process_id, batch_index, CAST(count(*) AS INTEGER) AS record_count, CAST(count(*) AS INTEGER) AS ids
FROM numbered WHERE process_id = 'P4' GROUP BY 1, 2""",
    )
    q["meta_lookup"] = _with(
        OUTCOMES,
        """SELECT process_id, outcome LIKE 'duplicate%' AS has_dedup, CASE WHEN outcome LIKE 'duplicate%' THEN outcome END AS reason,
  validation_status AS status, count(*) AS runs FROM outcomes GROUP BY ALL""",
    )
    q["merge_meta"] = _with(
        OUTCOMES,
        """SELECT 'state' AS key, run_status AS value, count(*) AS entries FROM outcomes GROUP BY 2
UNION ALL SELECT 'reason', CASE WHEN outcome LIKE 'duplicate%' THEN outcome ELSE '-' END, count(*) FROM outcomes GROUP BY 2
UNION ALL SELECT 'id', id, count(*) FROM outcomes GROUP BY 2
UNION ALL SELECT 'fecha', fecha, count(*) FROM outcomes GROUP BY 2""",
    )
    doomed = "(process_id = 'P1' AND run_status <> 'skipped')"
    q["jobs_deleted"] = _sizes(
        f"NOT {doomed}",
        f"job_id NOT IN (SELECT job_id FROM outcomes WHERE {doomed})",
        "TRUE",
        doomed,
        "TRUE",
        "TRUE",
        f"\nUNION ALL SELECT 'deleted', count(*), 0 FROM outcomes WHERE {doomed}",
    )
    other = "process_id <> 'P6'"
    q["process_deleted_soft"] = _sizes(other, other, "TRUE", "process_id = 'P6'", other, other)
    q["process_deleted_hard"] = _sizes(
        other,
        other,
        f"{other} AND id NOT IN (SELECT id FROM numbered WHERE process_id = 'P6')",
        "FALSE",
        other,
        other,
    )
    q["result_text"] = _with(HISTORY, "SELECT process_id, id, empleado_id, resultado_validacion FROM results")
    q["result_text_parsed"] = _with(
        HISTORY,
        """SELECT status, n_alerts AS alerts, least(n_alerts, 1) AS first_alerts, coalesce(m1, m2, m3) AS first_message, count(*) AS expenses
FROM results GROUP BY ALL""",
    )
    q["historical_regression"] = _with(
        HISTORY
        + """,
old AS (SELECT *, CASE WHEN old_days < 30 THEN 0 WHEN old_days < 60 THEN 1 ELSE 2 END AS o1,
    (old_days >= 30)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT AS o_alerts FROM results)""",
        """SELECT process_id, id, empleado_id, CASE greatest(o1, s2, s3) WHEN 0 THEN 'APROBADO' WHEN 1 THEN 'PENDIENTE' ELSE 'RECHAZADO' END AS recorded,
  status, o_alerts AS recorded_alerts, n_alerts AS alerts FROM old WHERE o1 <> s1""",
    )
    q["policy_shape"] = _with(DOCUMENTS, "SELECT kind, shape AS errors, count(*) AS documents FROM checked GROUP BY ALL")
    q["policy_contract"] = _with(DOCUMENTS, "SELECT kind, contract AS errors, count(*) AS documents FROM checked GROUP BY ALL")
    q["policy_resolution"] = _with(
        DOCUMENTS
        + """,
sources AS (
  SELECT kind, CASE WHEN kind IN (0, 1, 5, 10) THEN policies END AS chosen,
    CASE WHEN kind = 2 THEN '{not json' WHEN kind <> 3 THEN '{"moneda_base": "CLP"}' END AS fallback FROM docs0)""",
        """SELECT kind, upper(coalesce(nullif(trim(coalesce(chosen, CASE WHEN json_valid(fallback) THEN fallback END) ->> '$.moneda_base'), ''), 'eur')) AS base,
  CASE WHEN chosen IS NULL AND NOT json_valid(fallback) THEN 'DEFAULT_POLICIES debe ser un JSON válido cuando se utiliza como fallback'
    WHEN chosen IS NULL AND fallback IS NULL THEN 'No se proporcionaron politicas y DEFAULT_POLICIES no está configurado' END AS error, count(*) AS documents
FROM sources GROUP BY ALL""",
    )
    q["policy_upsert"] = _with(
        DOCUMENTS,
        """SELECT name, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN base END AS base,
  CASE WHEN c_custkey % 3 <> 0 THEN '2000' ELSE '2001' END || '-01-01 00:00:00' AS created_at,
  CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN '2001' ELSE '2000' END || '-01-01 00:00:00' AS updated_at
FROM checked WHERE shape = ''""",
    )
    q["tenant_policies"] = _with(
        BASE
        + ","
        + DOCUMENTS
        + """,
force AS (
  SELECT c_custkey, CASE WHEN shape = '' THEN 'own' ELSE 'default' END AS policy_from, CASE WHEN shape = '' THEN nullif(contract, '') END AS refusal,
    CASE WHEN shape = '' THEN j ELSE CAST('{"moneda_base":"USD","limite_antiguedad":{"pendiente_dias":30,"rechazado_dias":60},"limites_por_categoria":{"food":{"aprobado_hasta":100,"pendiente_hasta":150},'
      || '"transport":{"aprobado_hasta":200,"pendiente_hasta":250}},"reglas_centro_costo":[{"cost_center":"core_engineering","categoria_prohibida":"food"}]}' AS JSON) END AS p FROM checked),
rows0 AS (
  SELECT raw.*, policy_from, refusal, p, greatest(0, date_diff('day', CAST(fecha AS DATE), DATE '2001-01-01')) AS days, p ->> '$.moneda_base' AS own_base,
    CAST(p ->> '$.limite_antiguedad.pendiente_dias' AS DOUBLE) AS d1, CAST(p ->> '$.limite_antiguedad.rechazado_dias' AS DOUBLE) AS d2,
    CAST(p ->> ('$.limites_por_categoria.' || categoria || '.aprobado_hasta') AS DOUBLE) AS upto, CAST(p ->> ('$.limites_por_categoria.' || categoria || '.pendiente_hasta') AS DOUBLE) AS most,
    list_contains(list_transform(json_extract(p, '$.reglas_centro_costo[*]'), lambda r: (r ->> '$.cost_center') || '|' || (r ->> '$.categoria_prohibida')), cost_center || '|' || categoria) AS banned
  FROM raw LEFT JOIN force ON o_custkey = c_custkey WHERE monto >= 0),
marks AS (
  SELECT *, CASE WHEN days < d1 THEN 0 WHEN days < d2 THEN 1 ELSE 2 END AS s1, CASE WHEN upto IS NULL OR monto <= upto THEN 0 WHEN monto <= most THEN 1 ELSE 2 END AS s2,
    CASE WHEN banned THEN 2 ELSE 0 END AS s3, (upto IS NULL OR monto > upto)::INT AS a2,
    coalesce(refusal, CASE WHEN moneda <> own_base THEN 'monto_base es requerido cuando moneda_original difiere de moneda_base' END) AS error FROM rows0)""",
        """SELECT policy_from, status, error, count(*) AS expenses, CAST(sum(alerts) AS BIGINT) AS alerts FROM (
  SELECT policy_from, error, CASE WHEN error IS NULL THEN CASE greatest(s1, s2, s3) WHEN 0 THEN 'APROBADO' WHEN 1 THEN 'PENDIENTE' ELSE 'RECHAZADO' END END AS status,
    CASE WHEN error IS NULL THEN (s1 > 0)::INT + a2 + (s3 > 0)::INT END AS alerts FROM marks) GROUP BY policy_from, status, error""",
    )
    q["safe_file_names"] = "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name FROM pages"
    q["admissible_files"] = """SELECT page_id, filename FROM (
  SELECT page_id, split_part(url, '/', -1) || CASE page_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' WHEN 2 THEN '.txt' WHEN 3 THEN '.csv.gz' ELSE '.Csv' END AS filename
  FROM pages) WHERE lower(filename) LIKE '%.csv'"""
    q["stream_dedup_ttl"] = """WITH RECURSIVE chain AS (
  SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY ALL
  UNION ALL
  SELECT c.event_type, c.user_id, min(e.ts) FROM chain c JOIN events e
    ON e.event_type = c.event_type AND e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 86400 SECOND GROUP BY ALL
)
SELECT e.event_id, e.event_type, e.user_id, CASE WHEN c.ts IS NULL THEN 'skipped' ELSE 'first' END AS mark
FROM events e LEFT JOIN chain c ON c.event_type = e.event_type AND c.user_id = e.user_id AND c.ts = e.ts"""
    return q
