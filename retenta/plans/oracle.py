"""DuckDB SQL that computes every registered query independently of Spark.

The CTEs mirror :mod:`retenta.sources.fixtures` (driver tables → domain tables);
each query below restates its operator in plain SQL. Conventions shared with the
Spark side: half-even rounding (``round_even``), money summed as
``decimal(18,2)``, whole days as 24-hour blocks, months as ``yyyy-MM`` text,
timestamps as ``yyyy-MM-dd HH:mm:ss`` text, integer sums cast to BIGINT.
"""

from __future__ import annotations

DAYS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000) AS BIGINT)"


def days_between(a: str, b: str) -> str:
    return DAYS.format(a=a, b=b)


CLIENTS = f"""
active_products AS (
  SELECT o_custkey AS user_id, count(*) AS num_productos_activos
  FROM (SELECT DISTINCT o.o_custkey, p.p_type
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                        JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_returnflag = 'R') t
  GROUP BY o_custkey
),
last_order AS (
  SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey
),
overall_last AS (SELECT max(o_orderdate) AS overall_last_order FROM orders),
clients AS (
  SELECT c.c_custkey AS user_id,
         n.n_name AS estado,
         concat_ws('-', n.n_name, c.c_mktsegment) AS ciudad,
         14 + (c.c_custkey * 7) % 110 AS edad,
         c.c_acctbal AS ingreso_mensual_mxn,
         CASE WHEN c.c_custkey % 13 <> 0 THEN (c.c_custkey * 37) % 121 END AS dias_desde_ultimo_login,
         CASE WHEN c.c_custkey % 11 <> 0 THEN CAST(1 + c.c_custkey % 10 AS DOUBLE) END AS satisfaccion_1_10,
         CAST(coalesce(ap.num_productos_activos, 0) AS BIGINT) AS num_productos_activos,
         c.c_custkey % 4 = 0 AS es_hey_pro,
         CASE WHEN {days_between('lo.last_order', 'ol.overall_last_order')} > 180
              THEN 'CHURN' ELSE 'NO CHURN' END AS UsuarioChurn
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN active_products ap ON ap.user_id = c.c_custkey
  LEFT JOIN last_order lo ON lo.o_custkey = c.c_custkey
  CROSS JOIN overall_last ol
)"""

TRANSACTIONS = """
transactions AS (
  SELECT o_custkey AS user_id, o_totalprice AS monto, o_orderdate AS fecha_hora,
         o_orderpriority AS tipo_operacion
  FROM orders
)"""

TX_SUMMARY = f"""
tx_per_user AS (
  SELECT user_id, count(monto) AS total_tx,
         coalesce(CAST(sum(CAST(monto AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS monto_total,
         max(fecha_hora) AS ultima_tx
  FROM transactions GROUP BY user_id
),
tx_overall AS (SELECT max(fecha_hora) AS fecha_max FROM transactions),
tx_summary AS (
  SELECT t.user_id, t.total_tx, t.monto_total, t.ultima_tx,
         {days_between('t.ultima_tx', 'o.fecha_max')} AS dias_sin_tx
  FROM tx_per_user t CROSS JOIN tx_overall o WHERE t.user_id IS NOT NULL
)"""

SCORED = """
score_parts AS (
  SELECT c.*, s.total_tx, s.monto_total, s.ultima_tx, s.dias_sin_tx,
    CASE WHEN c.dias_desde_ultimo_login IS NOT NULL
         THEN least(greatest(c.dias_desde_ultimo_login, 0), 90) END / CAST(90 AS DOUBLE) * CAST(35 AS DOUBLE)
      AS score_login,
    (CAST(10 AS DOUBLE) - coalesce(CAST(c.satisfaccion_1_10 AS DOUBLE), CAST(5 AS DOUBLE)))
      / CAST(9 AS DOUBLE) * CAST(25 AS DOUBLE) AS score_satisfaccion,
    (CAST(5 AS DOUBLE) - CASE WHEN c.num_productos_activos IS NOT NULL
         THEN least(greatest(c.num_productos_activos, 0), 5) END) / CAST(5 AS DOUBLE) * CAST(20 AS DOUBLE)
      AS score_productos,
    least(greatest(coalesce(s.dias_sin_tx, 90), 0), 90) / CAST(90 AS DOUBLE) * CAST(20 AS DOUBLE) AS score_tx
  FROM clients c LEFT JOIN tx_summary s ON c.user_id = s.user_id
),
scored AS (
  SELECT *, CASE WHEN churn_score > 0 AND churn_score <= 30 THEN 'Bajo'
                 WHEN churn_score > 30 AND churn_score <= 60 THEN 'Medio'
                 WHEN churn_score > 60 AND churn_score <= 100 THEN 'Alto' END AS riesgo
  FROM (SELECT *, round_even(score_login + score_satisfaccion + score_productos + score_tx, 1) AS churn_score
        FROM score_parts) x
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


BASE_SCORED = with_ctes(CLIENTS, TRANSACTIONS, TX_SUMMARY, SCORED)

# integer columns that can hold nulls are handed over as DOUBLE (as the Spark side does)
SCORED_COLUMNS = """user_id, estado, ciudad, edad, ingreso_mensual_mxn,
  CAST(dias_desde_ultimo_login AS DOUBLE) AS dias_desde_ultimo_login,
  satisfaccion_1_10, num_productos_activos, es_hey_pro, UsuarioChurn, CAST(total_tx AS DOUBLE) AS total_tx,
  monto_total, strftime(ultima_tx, '%Y-%m-%d %H:%M:%S') AS ultima_tx, CAST(dias_sin_tx AS DOUBLE) AS dias_sin_tx,
  score_login, score_satisfaccion, score_productos, score_tx, churn_score, riesgo"""


def churn_scores() -> str:
    return f"{BASE_SCORED}\nSELECT {SCORED_COLUMNS} FROM scored"


HIGH_RISK_PAGE_COLUMNS = """user_id, estado, ciudad, churn_score, satisfaccion_1_10,
  CAST(dias_desde_ultimo_login AS DOUBLE) AS dias_desde_ultimo_login,
  num_productos_activos, es_hey_pro, ingreso_mensual_mxn, CAST(total_tx AS DOUBLE) AS total_tx"""


def search_clients(q: str = "1.1", limit: int = 20) -> str:
    return f"""{BASE_SCORED}
SELECT user_id, estado, ciudad, churn_score, riesgo, satisfaccion_1_10, es_hey_pro FROM scored
WHERE coalesce(regexp_matches(CAST(user_id AS VARCHAR), '(?i){q}'), false)
ORDER BY user_id LIMIT {limit}"""


def _high_risk_filtered(estado: str | None, score_min: float, score_max: float) -> str:
    state = f"AND lower(estado) = '{estado.lower()}'" if estado else ""
    return f"""filtered AS (
  SELECT * FROM scored WHERE riesgo = 'Alto' {state}
    AND churn_score BETWEEN CAST({score_min} AS DOUBLE) AND CAST({score_max} AS DOUBLE))"""


def high_risk_page(page: int, page_size: int, estado: str | None = None, score_min: float = 0.0,
                   score_max: float = 100.0) -> str:
    return f"""{BASE_SCORED}, {_high_risk_filtered(estado, score_min, score_max)},
meta AS (SELECT count(*) AS total, {page} AS page, {page_size} AS page_size,
                CAST(ceil(count(*) / {page_size}) AS BIGINT) AS pages FROM filtered)
SELECT p.*, meta.* FROM (
  SELECT {HIGH_RISK_PAGE_COLUMNS} FROM filtered ORDER BY churn_score DESC, user_id
  LIMIT {page_size} OFFSET {(page - 1) * page_size}) p CROSS JOIN meta"""


def indexed_page(page: int, page_size: int, estado: str | None = None, score_min: float = 0.0,
                 score_max: float = 100.0) -> str:
    """As a page, but the totals are there without clients too; then all else is null, so ids,
    counts and flags are doubles."""
    return f"""{BASE_SCORED}, {_high_risk_filtered(estado, score_min, score_max)},
meta AS (SELECT count(*) AS total, {page} AS page, {page_size} AS page_size,
                CAST(ceil(count(*) / {page_size}) AS BIGINT) AS pages FROM filtered)
SELECT p.* REPLACE (CAST(user_id AS DOUBLE) AS user_id, CAST(num_productos_activos AS DOUBLE) AS num_productos_activos,
                    CAST(es_hey_pro AS DOUBLE) AS es_hey_pro), meta.* FROM meta LEFT JOIN (
  SELECT {HIGH_RISK_PAGE_COLUMNS} FROM filtered ORDER BY churn_score DESC, user_id
  LIMIT {page_size} OFFSET {(page - 1) * page_size}) p ON true"""


def high_risk_after(last_score: float, last_id: int, page_size: int) -> str:
    return f"""{BASE_SCORED}, {_high_risk_filtered(None, 0.0, 100.0)}
SELECT {HIGH_RISK_PAGE_COLUMNS} FROM filtered
WHERE churn_score < CAST({last_score} AS DOUBLE)
   OR (churn_score = CAST({last_score} AS DOUBLE) AND user_id > {last_id})
ORDER BY churn_score DESC, user_id LIMIT {page_size}"""


def transaction_pages(page: int, page_size: int) -> str:
    first, last = (page - 1) * page_size + 1, page * page_size
    return f"""WITH {TRANSACTIONS},
keyed AS (SELECT * FROM transactions WHERE user_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id
             ORDER BY fecha_hora DESC, monto DESC, tipo_operacion ASC) AS pos FROM keyed),
totals AS (SELECT user_id, count(*) AS total FROM keyed GROUP BY user_id)
SELECT r.user_id, r.monto, strftime(r.fecha_hora, '%Y-%m-%d %H:%M:%S') AS fecha_hora, r.tipo_operacion,
       r.pos, t.total, CAST(ceil(t.total / {page_size}) AS BIGINT) AS pages
FROM ranked r JOIN totals t ON r.user_id = t.user_id WHERE r.pos BETWEEN {first} AND {last}"""


CONVERSATIONS = """
conv AS (SELECT user_id, ts AS date, event_type AS input, event_id FROM events)"""


def conversation_histories() -> str:
    return f"""WITH {CONVERSATIONS},
keyed AS (SELECT * FROM conv WHERE user_id IS NOT NULL),
totals AS (SELECT user_id, count(*) AS total FROM keyed GROUP BY user_id)
SELECT k.user_id, strftime(k.date, '%Y-%m-%d %H:%M:%S.%f') AS date, k.input, k.event_id, t.total
FROM keyed k JOIN totals t ON k.user_id = t.user_id"""


def score_card() -> str:
    return f"""{BASE_SCORED}
SELECT user_id AS id, churn_score AS score, riesgo,
       CASE WHEN churn_score >= 70 THEN 'Contacto urgente' ELSE 'Monitoreo estándar' END AS suggestion
FROM scored"""


def high_risk_top(k: int = 20, threshold: float = 60.0) -> str:
    return f"""WITH {CLIENTS}, {TRANSACTIONS},
counts AS (SELECT user_id, count(monto) AS total_tx FROM transactions WHERE user_id IS NOT NULL GROUP BY user_id),
labelled AS (SELECT c.*, CASE WHEN upper(trim(UsuarioChurn)) = 'CHURN' THEN CAST(95 AS DOUBLE)
                              ELSE CAST(20 AS DOUBLE) END AS churn_score FROM clients c)
SELECT s.user_id, s.estado, s.ciudad, s.churn_score,
       coalesce(s.satisfaccion_1_10, CAST(0 AS DOUBLE)) AS satisfaccion_1_10,
       coalesce(s.dias_desde_ultimo_login, 0) AS dias_desde_ultimo_login,
       coalesce(s.num_productos_activos, 0) AS num_productos_activos,
       coalesce(k.total_tx, 0) AS total_tx,
       coalesce(s.ingreso_mensual_mxn, CAST(0 AS DOUBLE)) AS ingreso_mensual_mxn, count(*) OVER () AS total
FROM labelled s LEFT JOIN counts k ON s.user_id = k.user_id
WHERE s.churn_score >= CAST({threshold} AS DOUBLE)
ORDER BY s.churn_score DESC, s.user_id LIMIT {k}"""


D = "CAST({} AS DOUBLE)"


def dbl(x) -> str:
    return D.format(x)


KPI_TABLE = f"""
tx_m AS (
  SELECT CAST(date_trunc('month', fecha_hora) AS DATE) AS mes,
         CAST(sum(CAST(monto AS DECIMAL(18,2))) AS DOUBLE) AS monto_total, count(*) AS num_transacciones
  FROM transactions GROUP BY 1),
conv_m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS mes, count(*) AS num_inputs FROM conv GROUP BY 1),
last_tx AS (SELECT user_id, max(fecha_hora) AS ultima_tx FROM transactions WHERE user_id IS NOT NULL GROUP BY 1),
tx_max AS (SELECT max(fecha_hora) AS fecha_max FROM transactions),
churn_m AS (
  SELECT CAST(date_trunc('month', ultima_tx + INTERVAL 181 DAY) AS DATE) AS mes, count(*) AS nuevos_churn
  FROM last_tx CROSS JOIN tx_max WHERE ultima_tx + INTERVAL 181 DAY <= fecha_max GROUP BY 1),
kpi_months AS (SELECT mes FROM tx_m UNION SELECT mes FROM conv_m UNION SELECT mes FROM churn_m),
kpi AS (
  SELECT m.mes, coalesce(t.monto_total, {dbl(0)}) AS monto_total,
         CAST(coalesce(c.num_inputs, 0) AS BIGINT) AS num_inputs,
         CAST(coalesce(ch.nuevos_churn, 0) AS BIGINT) AS nuevos_churn,
         CAST(coalesce(t.num_transacciones, 0) AS BIGINT) AS num_transacciones
  FROM kpi_months m LEFT JOIN tx_m t ON m.mes = t.mes LEFT JOIN conv_m c ON m.mes = c.mes
       LEFT JOIN churn_m ch ON m.mes = ch.mes)"""

BASE_KPI = with_ctes(TRANSACTIONS, CONVERSATIONS, KPI_TABLE)
KPI_NAMES = [("monto_total", "monto_total", False), ("num_inputs", "num_inputs", False),
             ("nuevos_churns", "nuevos_churn", True), ("num_transacciones", "num_transacciones", False)]
MONTHS_LONG = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"
MONTHS_SHORT = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"


def monthly_kpis() -> str:
    return f"""{BASE_KPI}
SELECT strftime(mes, '%Y-%m') AS mes, monto_total, num_inputs, nuevos_churn, num_transacciones FROM kpi"""


def months() -> str:
    return f"""{BASE_KPI}
SELECT mes, {MONTHS_LONG}[CAST(substr(mes, 6, 2) AS INTEGER)] || ' de ' || substr(mes, 1, 4) AS etiqueta
FROM (SELECT DISTINCT strftime(mes, '%Y-%m') AS mes FROM kpi WHERE mes IS NOT NULL) t"""


def _pct(valor: str, previo: str) -> str:
    return (f"CASE WHEN {previo} = 0 THEN CASE WHEN {valor} > 0 THEN {dbl(100)} ELSE {dbl(0)} END "
            f"ELSE round_even(({valor} - {previo}) / abs({previo}) * {dbl(100)}, 1) END")


def _long(source: str, keep: str = "") -> str:
    parts = []
    for name, _, inverted in KPI_NAMES:
        parts.append(f"SELECT {keep}'{name}' AS kpi, {name}__valor AS valor, {name}__previo AS previo, "
                     f"{'TRUE' if inverted else 'FALSE'} AS inv FROM {source}")
    union = "\nUNION ALL ".join(parts)
    cols = f"{keep}kpi, valor, previo"
    return f"""SELECT {cols}, porcentaje, CASE WHEN inv THEN porcentaje <= 0 ELSE porcentaje >= 0 END AS es_bueno
FROM (SELECT *, {_pct('valor', 'previo')} AS porcentaje FROM ({union}) u) x"""


def global_kpis(month: str) -> str:
    y, m = (int(x) for x in month.split("-"))
    cur = f"DATE '{y:04d}-{m:02d}-01'"
    py, pm = (y, m - 1) if m > 1 else (y - 1, 12)
    ny, nm = (y, m + 1) if m < 12 else (y + 1, 1)
    prev = f"DATE '{py:04d}-{pm:02d}-01'"
    nxt = f"DATE '{ny:04d}-{nm:02d}-01'"
    sums = []
    for name, src, _ in KPI_NAMES:
        val = f"CAST({src} AS DECIMAL(18,2))" if src == "monto_total" else src
        sums.append(f"coalesce(CAST(sum(CASE WHEN mes >= {cur} AND mes < {nxt} THEN {val} END) AS DOUBLE), {dbl(0)}) AS {name}__valor")
        sums.append(f"coalesce(CAST(sum(CASE WHEN mes >= {prev} AND mes < {cur} THEN {val} END) AS DOUBLE), {dbl(0)}) AS {name}__previo")
    return f"""{BASE_KPI},
sums AS (SELECT {', '.join(sums)} FROM kpi WHERE mes >= {prev} AND mes < {nxt}),
cards AS ({_long('sums')})
SELECT *, CASE WHEN kpi = 'monto_total' THEN printf('$%.1fM', round_even(valor / {dbl(1000000)}, 1))
               ELSE format('{{:,.0f}}', valor) END AS valor_texto
FROM cards"""


def kpi_changes() -> str:
    tot = ", ".join(
        (f"CAST(sum(CAST({src} AS DECIMAL(18,2))) AS DOUBLE) AS {name}" if src == "monto_total"
         else f"CAST(sum({src}) AS DOUBLE) AS {name}")
        for name, src, _ in KPI_NAMES)
    sel = ", ".join(f"t.{n} AS {n}__valor, coalesce(p.{n}, {dbl(0)}) AS {n}__previo" for n, _, _ in KPI_NAMES)
    return f"""{BASE_KPI},
totals AS (SELECT CAST(date_trunc('month', mes) AS DATE) AS mes, {tot} FROM kpi GROUP BY 1),
joined AS (SELECT strftime(t.mes, '%Y-%m') AS mes, {sel}
           FROM totals t LEFT JOIN totals p ON p.mes + INTERVAL 1 MONTH = t.mes)
{_long('joined', keep='mes, ')}"""


def churn_timeline() -> str:
    return f"""{BASE_KPI}
SELECT strftime(mes, '%Y-%m') AS mes, nuevos_churn FROM kpi WHERE mes IS NOT NULL ORDER BY mes"""


BASE_CLIENTS = with_ctes(CLIENTS)


def churn_label_counts() -> str:
    return f"{BASE_CLIENTS}\nSELECT UsuarioChurn, count(*) AS count FROM clients GROUP BY UsuarioChurn"


def churn_counts() -> str:
    return f"""{BASE_CLIENTS},
counts AS (SELECT UsuarioChurn, count(*) AS count FROM clients GROUP BY UsuarioChurn),
w AS (SELECT CAST(coalesce(sum(CASE WHEN upper(trim(UsuarioChurn)) = 'CHURN' THEN count END), 0) AS BIGINT) AS c,
             CAST(coalesce(sum(CASE WHEN upper(trim(UsuarioChurn)) = 'NO CHURN' THEN count END), 0) AS BIGINT) AS n
      FROM counts)
SELECT 'Churn' AS status, c AS cantidad FROM w UNION ALL SELECT 'No Churn', n FROM w"""


def churn_totals() -> str:
    return f"""{BASE_CLIENTS},
w AS (SELECT count(CASE WHEN upper(trim(UsuarioChurn)) IN ('1', '1.0', 'CHURN') THEN 1 END) AS c,
             count(CASE WHEN upper(trim(UsuarioChurn)) IS NULL
                          OR upper(trim(UsuarioChurn)) NOT IN ('1', '1.0', 'CHURN') THEN 1 END) AS n
      FROM clients)
SELECT 'No Churn' AS status, n AS cantidad FROM w UNION ALL SELECT 'Churn', c FROM w"""


def _ratio(num: str, den: str) -> str:
    return f"round_even(CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE) * {dbl(100)}, 1)"


def _severity(p: str) -> str:
    return (f"CASE WHEN {p} >= 55 THEN 'Crítico' WHEN {p} >= 40 THEN 'Alto' "
            f"WHEN {p} >= 25 THEN 'Medio' ELSE 'Bajo' END")


def _shade(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN CAST(NULL AS INTEGER) WHEN {p} >= 14 THEN 4 WHEN {p} >= 12 THEN 3 "
            f"WHEN {p} >= 10 THEN 2 WHEN {p} >= 8 THEN 1 ELSE 0 END")


STATE_MAP = f"""
state_grp AS (
  SELECT estado, count(user_id) AS clientes,
         CAST(sum(CAST(coalesce(upper(trim(UsuarioChurn)) = 'CHURN', false) AS INTEGER)) AS BIGINT) AS churn_sum
  FROM clients WHERE estado IS NOT NULL GROUP BY estado),
state_map AS (
  SELECT estado AS nombre, clientes, {_ratio('churn_sum', 'clientes')} AS churn_pct FROM state_grp)"""


def state_map() -> str:
    return f"""{with_ctes(CLIENTS, STATE_MAP)}
SELECT nombre, clientes, churn_pct, {_severity('churn_pct')} AS severidad, {_shade('churn_pct')} AS nivel
FROM state_map"""


def age_profile() -> str:
    edges = [17, 25, 35, 45, 55, 65, 120]
    labels = ["18–25", "26–35", "36–45", "46–55", "56–65", "65+"]
    band = " ".join(f"WHEN edad > {edges[i]} AND edad <= {edges[i+1]} THEN '{labels[i]}'" for i in range(6))
    rank = " ".join(f"WHEN edad > {edges[i]} AND edad <= {edges[i+1]} THEN {i+1}" for i in range(6))
    return f"""{BASE_CLIENTS},
banded AS (
  SELECT CASE {band} END AS rango_edad, CASE {rank} END AS orden,
         CAST(round(ingreso_mensual_mxn * {dbl(100)}) AS BIGINT) AS cents,
         CAST(coalesce(upper(trim(UsuarioChurn)) = 'CHURN', false) AS INTEGER) AS churn, user_id
  FROM clients),
grp AS (
  SELECT rango_edad, orden, sum(cents) AS cents_sum, count(cents) AS cents_n,
         CAST(sum(churn) AS BIGINT) AS churn_sum, count(user_id) AS total
  FROM banded WHERE rango_edad IS NOT NULL GROUP BY rango_edad, orden)
SELECT rango_edad, orden,
       CAST(round_even(CAST(cents_sum AS DOUBLE) / CAST(nullif(cents_n, 0) AS DOUBLE) / {dbl(100)}, 0) AS BIGINT)
         AS ingreso_promedio,
       {_ratio('churn_sum', 'total')} AS churn_pct, total
FROM grp"""


PRODUCTS = """
products AS (
  SELECT o.o_custkey AS user_id, p.p_type AS producto, l.l_shipdate AS fecha_apertura
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""

USAGE = f"""
pairs AS (SELECT producto, user_id, count(*) AS n FROM products
          WHERE producto IS NOT NULL AND user_id IS NOT NULL GROUP BY producto, user_id),
usage AS (
  SELECT pr.producto, CAST(sum(pr.n) AS BIGINT) AS usos, count(*) AS clientes,
         CAST(coalesce(sum(CAST(coalesce(upper(trim(c.UsuarioChurn)) = 'CHURN', false) AS INTEGER)), 0) AS BIGINT)
           AS churn_sum
  FROM pairs pr LEFT JOIN clients c ON pr.user_id = c.user_id GROUP BY pr.producto)"""


def product_usage_table() -> str:
    return f"""{with_ctes(CLIENTS, PRODUCTS, USAGE)}
SELECT producto, usos, clientes, {_ratio('churn_sum', 'clientes')} AS churn_pct FROM usage"""


def product_usage(n: int) -> str:
    return f"""{with_ctes(CLIENTS, PRODUCTS, USAGE)},
clean AS (SELECT CAST(producto AS VARCHAR) AS producto, usos,
                 coalesce(round_even({_ratio('churn_sum', 'clientes')}, 1), {dbl(0)}) AS churn_pct FROM usage),
top AS (SELECT * FROM clean ORDER BY usos DESC, producto LIMIT {n}),
mx AS (SELECT greatest(coalesce(max(usos), 0), 1) AS max_usos FROM top)
SELECT producto, usos, churn_pct, round_even(usos / max_usos * {dbl(100)}, 1) AS share
FROM top CROSS JOIN mx"""


def income_sample(n: int, seed: int) -> str:
    return f"""{BASE_CLIENTS}
SELECT edad, ingreso, status FROM (
  SELECT edad, ingreso_mensual_mxn AS ingreso,
         CASE WHEN CAST(UsuarioChurn AS VARCHAR) IN ('1', '1.0', 'CHURN') THEN 'CHURN' ELSE 'NO CHURN' END AS status,
         md5('{seed}' || '-' || CAST(user_id AS VARCHAR)) AS h, user_id
  FROM clients ORDER BY h, user_id LIMIT {n}) t"""


def region_match() -> str:
    return f"""{with_ctes(CLIENTS, STATE_MAP)},
layer AS (SELECT n_nationkey AS map_order,
                 CASE WHEN n_nationkey % 2 = 1 THEN 'estado ' || lower(n_name) ELSE lower(n_name) END AS map_name
          FROM nation),
pairs AS (
  SELECT l.map_order, l.map_name, s.nombre, s.clientes, s.churn_pct,
         row_number() OVER (PARTITION BY l.map_order, l.map_name ORDER BY s.nombre ASC NULLS LAST, s.nombre) AS rn
  FROM layer l LEFT JOIN state_map s ON coalesce(
       (contains(lower(s.nombre), 'cdmx') AND (contains(lower(l.map_name), 'distrito')
                                              OR contains(lower(l.map_name), 'ciudad de')))
    OR (contains(lower(s.nombre), 'estado de méxico') AND lower(l.map_name) = 'méxico')
    OR contains(lower(s.nombre), lower(l.map_name)) OR contains(lower(l.map_name), lower(s.nombre)), false))
SELECT map_order, map_name, nombre, clientes, churn_pct, {_shade('churn_pct')} AS nivel FROM pairs WHERE rn = 1"""


def state_lookup() -> str:
    return f"""{with_ctes(CLIENTS, STATE_MAP)},
latest AS (SELECT nombre, clientes, churn_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY nombre ORDER BY clientes DESC) AS rn FROM state_map) t WHERE rn = 1)
SELECT n.n_nationkey AS map_order, n.n_name AS map_name, l.clientes, l.churn_pct
FROM nation n LEFT JOIN latest l ON n.n_name = l.nombre"""


INPUTS = """
inputs AS (SELECT l.l_shipdate AS fecha, p.p_type AS input
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

TOP_INPUTS = """
top_inputs AS (
  SELECT month, input, count FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY count DESC, input ASC) AS rk FROM (
      SELECT CAST(date_trunc('month', fecha) AS DATE) AS month, input, count(*) AS count
      FROM inputs WHERE input IS NOT NULL GROUP BY 1, 2) g) r
  WHERE rk <= {k})"""

TOP_OPS = """
top_ops AS (
  SELECT month, tipo_operacion, monto FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY monto DESC, tipo_operacion ASC) AS rk FROM (
      SELECT CAST(date_trunc('month', fecha_hora) AS DATE) AS month, tipo_operacion,
             CAST(sum(CAST(monto AS DECIMAL(18,2))) AS DOUBLE) AS monto
      FROM transactions WHERE tipo_operacion IS NOT NULL GROUP BY 1, 2) g) r
  WHERE rk <= {k})"""


def top_inputs_by_month(k: int) -> str:
    return f"""{with_ctes(INPUTS, TOP_INPUTS.format(k=k))}
SELECT strftime(month, '%Y-%m') AS month, input, count FROM top_inputs"""


def top_operations_by_month(k: int) -> str:
    return f"""{with_ctes(TRANSACTIONS, TOP_OPS.format(k=k))}
SELECT strftime(month, '%Y-%m') AS month, tipo_operacion, monto FROM top_ops"""


def _month_label(d: str) -> str:
    return f"{MONTHS_SHORT}[month({d})] || ' ' || CAST(year({d}) AS VARCHAR)"


def inputs_pivot(k: int, values: list[str]) -> str:
    cells = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN input = '{v}' THEN count END), 0) AS BIGINT) AS \"{v}\"" for v in values)
    listed = ", ".join(f"'{v}'" for v in values)
    cells += f", CAST(coalesce(sum(CASE WHEN input IN ({listed}) THEN 0 ELSE count END), 0) AS BIGINT) AS otros"
    return f"""{with_ctes(INPUTS, TOP_INPUTS.format(k=k))}
SELECT strftime(month, '%Y-%m') AS mes_clave, {_month_label('month')} AS mes, {cells}
FROM top_inputs GROUP BY month ORDER BY mes_clave"""


def operations_pivot(k: int, values: list[str]) -> str:
    sums = [f"coalesce(sum(CASE WHEN tipo_operacion = '{v}' THEN CAST(monto AS DECIMAL(18,2)) END), 0)" for v in values]
    cells = ", ".join(f"round_even(CAST({c} AS DOUBLE) / {dbl(1000000)}, 2) AS \"{v}\"" for c, v in zip(sums, values))
    listed = ", ".join(f"'{v}'" for v in values)
    amount = "CAST(monto AS DECIMAL(18,2))"
    others = f"coalesce(sum(CASE WHEN tipo_operacion IN ({listed}) THEN 0 ELSE {amount} END), 0)"
    cells += f", round_even(CAST({others} AS DOUBLE) / {dbl(1000000)}, 2) AS otros"
    total = f"coalesce(sum({amount}), 0)"
    return f"""{with_ctes(TRANSACTIONS, TOP_OPS.format(k=k))}
SELECT strftime(month, '%Y-%m') AS mes_clave, {_month_label('month')} AS mes, {cells},
       round_even(CAST({total} AS DOUBLE) / {dbl(1000000)}, 2) AS total
FROM top_ops GROUP BY month ORDER BY mes_clave"""


HIGH_RISK = f"""
tx_counts AS (SELECT user_id, count(monto) AS total_tx FROM transactions WHERE user_id IS NOT NULL GROUP BY user_id),
high_risk AS (
  SELECT s.user_id, s.estado, s.ciudad, s.churn_score,
         coalesce(s.satisfaccion_1_10, {dbl(0)}) AS satisfaccion_1_10,
         coalesce(s.dias_desde_ultimo_login, 0) AS dias_desde_ultimo_login,
         coalesce(s.num_productos_activos, 0) AS num_productos_activos,
         coalesce(k.total_tx, 0) AS total_tx,
         coalesce(s.ingreso_mensual_mxn, {dbl(0)}) AS ingreso_mensual_mxn
  FROM (SELECT c.*, CASE WHEN upper(trim(UsuarioChurn)) = 'CHURN' THEN {dbl(95)} ELSE {dbl(20)} END AS churn_score
        FROM clients c) s
  LEFT JOIN tx_counts k ON s.user_id = k.user_id
  WHERE s.churn_score >= {dbl(60)})"""


def _js_num(x: str) -> str:
    return (f"CASE WHEN CAST({x} AS DOUBLE) = floor(CAST({x} AS DOUBLE)) "
            f"THEN CAST(CAST(floor(CAST({x} AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END")


def _sql_text(template: str) -> str:
    from ..operators.actions import Brand

    b = Brand()
    t = (template.replace("{assistant}", b.assistant).replace("{bank}", b.bank)
         .replace("{program}", b.program).replace("{points}", b.points))
    parts, rest = [], t
    values = {"sat": _js_num("sat"), "login": "CAST(login AS VARCHAR)", "estado": "coalesce(estado, '')"}
    while "{" in rest:
        before, after = rest.split("{", 1)
        name, rest = after.split("}", 1)
        if before:
            parts.append("'" + before.replace("'", "''") + "'")
        parts.append(values[name])
    if rest:
        parts.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(parts)


def _actions_select() -> str:
    from ..operators.actions import ACTIONS

    def pick(render) -> str:
        whens = " ".join(f"WHEN idx = {i} THEN {render(a)}" for i, a in enumerate(ACTIONS))
        return f"CASE {whens} END"

    msgs = ", ".join(f"{pick(lambda a, k=k: _sql_text(a['mensajes'][k]))} AS mensaje_{k + 1}" for k in range(3))
    return f"""SELECT user_id, estado, churn_score,
  CASE WHEN churn_score >= 80 THEN 'alto' WHEN churn_score >= 60 THEN 'medio' ELSE 'bajo' END AS nivel_score,
  sat <= 5 AS satisfaccion_baja,
  '$' || CAST(CAST(floor(coalesce(ingreso_mensual_mxn, {dbl(0)}) / {dbl(1000)} + {dbl(0.5)}) AS BIGINT) AS VARCHAR) || 'k'
    AS ingreso_k,
  CASE WHEN churn_score >= 70 THEN 'Contacto urgente' ELSE 'Monitoreo estándar' END AS sugerencia,
  {pick(lambda a: _sql_text(a['motivo']))} AS motivo,
  {pick(lambda a: _sql_text(a['oferta']))} AS oferta,
  {msgs},
  {pick(lambda a: _sql_text(a['respuesta']))} AS respuesta
FROM (SELECT *, CASE WHEN sat <= 5 THEN 0 WHEN login > 15 THEN 1 WHEN txs <= 3 THEN 2 ELSE 3 END AS idx
      FROM (SELECT *, coalesce(CAST(satisfaccion_1_10 AS DOUBLE), {dbl(0)}) AS sat,
                   coalesce(CAST(dias_desde_ultimo_login AS BIGINT), 0) AS login,
                   coalesce(CAST(total_tx AS BIGINT), 0) AS txs FROM high_risk) a) b"""


def retention_actions() -> str:
    return f"{with_ctes(CLIENTS, TRANSACTIONS, HIGH_RISK)}\n{_actions_select()}"


def action_messages() -> str:
    return f"""{with_ctes(CLIENTS, TRANSACTIONS, HIGH_RISK)}, acts AS ({_actions_select()})
SELECT user_id, CAST(1 AS BIGINT) AS orden, mensaje_1 AS mensaje FROM acts
UNION ALL SELECT user_id, CAST(2 AS BIGINT), mensaje_2 FROM acts
UNION ALL SELECT user_id, CAST(3 AS BIGINT), mensaje_3 FROM acts"""


def high_risk_search(term: str, n: int) -> str:
    return f"""{with_ctes(CLIENTS, TRANSACTIONS, HIGH_RISK)}
SELECT * FROM high_risk
WHERE coalesce(contains(lower(CAST(user_id AS VARCHAR)), lower('{term}')), false)
   OR coalesce(contains(lower(CAST(estado AS VARCHAR)), lower('{term}')), false)
ORDER BY churn_score DESC, user_id LIMIT {n}"""


def _mode_cte(name: str, source: str, value: str, out: str) -> str:
    return f"""
{name} AS (
  SELECT user_id, v AS {out} FROM (
    SELECT user_id, {value} AS v,
           row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {value} ASC) AS rn
    FROM {source} WHERE user_id IS NOT NULL AND {value} IS NOT NULL GROUP BY user_id, {value}) t
  WHERE rn = 1)"""


# The model's features in order, written out apart from the library's list.
_CLIENT_FEATURES = """edad sexo estado ciudad nivel_educativo ocupacion ingreso_mensual_mxn antiguedad_dias es_hey_pro
canal_apertura dias_desde_ultimo_login preferencia_canal satisfaccion_1_10 num_productos_activos input""".split()
_PRODUCTS = """credito_auto credito_nomina credito_personal cuenta_debito cuenta_negocios inversion_hey seguro_compras
seguro_vida tarjeta_credito_garantizada tarjeta_credito_hey tarjeta_credito_negocios""".split()
_MODES = "saldo_promedio dispositivo_moda canal_moda categoria_mcc_moda".split()
_OPERATIONS = """abono_inversion cargo_recurrente cashback compra deposito_farmacia deposito_oxxo pago_credito
pago_servicio retiro_cajero retiro_inversion transf_entrada transf_salida""".split()
_AMOUNTS = "monto_promedio monto_min monto_max".split()
_ALIGNED = ", ".join([*_CLIENT_FEATURES, *_PRODUCTS, *_MODES, *_OPERATIONS, *_AMOUNTS])


def _turn(values: list[str], key: str) -> str:
    """The values in turn, by a key."""
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


# Balances by the definition: a running balance, held from one movement to the next.
MOVES = f"""
moves AS (
  SELECT o_custkey AS user_id, o_totalprice AS monto, o_orderdate AS fecha_hora, o_orderpriority AS tipo_operacion,
         {_turn(_OPERATIONS, 'o_orderkey')} AS operacion FROM orders),
signed AS (
  SELECT user_id, fecha_hora AS t, operacion, CAST(floor(epoch_us(fecha_hora) / 1000000) AS BIGINT) AS s,
         CASE WHEN operacion IN ('cashback', 'deposito_farmacia', 'deposito_oxxo', 'retiro_inversion', 'transf_entrada')
              THEN 1 ELSE -1 END * CAST(round(monto * CAST(100 AS DOUBLE)) AS BIGINT) AS c
  FROM moves WHERE user_id IS NOT NULL AND monto IS NOT NULL AND fecha_hora IS NOT NULL),
until AS (SELECT max(fecha_hora) AS until, CAST(floor(epoch_us(max(fecha_hora)) / 1000000) AS BIGINT) AS until_s FROM moves),
running AS (
  SELECT user_id, t, s, c, CAST(sum(c) OVER w AS BIGINT) AS bal, lead(s, 1, until_s) OVER w AS nxt
  FROM signed CROSS JOIN until WINDOW w AS (PARTITION BY user_id ORDER BY s, c ROWS UNBOUNDED PRECEDING))"""

FEATURE_CTES = f"""{MOVES},
held AS (
  SELECT o.o_custkey AS user_id, p.p_type AS producto, {_turn(_PRODUCTS, 'l.l_partkey')} AS contrato
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
talks AS (
  SELECT user_id, event_type AS input,
         nullif(regexp_extract(CASE WHEN event_id % 17 = 0 THEN substr(props, 1, 5) WHEN event_id % 19 <> 0 THEN props END,
                               '^\\{{"k": ([0-9]+)\\}}$', 1), '') AS dispositivo FROM events),
pflags AS (SELECT user_id, {", ".join(f"bool_or(contrato = '{v}') AS {v}" for v in _PRODUCTS)}
           FROM held WHERE user_id IS NOT NULL GROUP BY user_id),
oflags AS (SELECT user_id, {", ".join(f"bool_or(operacion = '{v}') AS {v}" for v in _OPERATIONS)}
           FROM moves WHERE user_id IS NOT NULL GROUP BY user_id),
tx_stats AS (
  SELECT user_id,
         CAST(sum(CAST(round(monto * CAST(100 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(nullif(count(monto), 0) AS DOUBLE)
           / CAST(100 AS DOUBLE) AS monto_promedio,
         min(monto) AS monto_min, max(monto) AS monto_max, min(fecha_hora) AS primera, max(fecha_hora) AS ultima
  FROM moves WHERE user_id IS NOT NULL GROUP BY user_id),
saldos AS (
  SELECT user_id,
         CASE WHEN max(until_s) > min(s)
              THEN CAST(CAST(sum(CAST(bal AS HUGEINT) * (nxt - s)) AS BIGINT) AS DOUBLE) / CAST(max(until_s) - min(s) AS DOUBLE)
              ELSE CAST(CAST(sum(c) AS BIGINT) AS DOUBLE) END / CAST(100 AS DOUBLE) AS saldo_promedio
  FROM running CROSS JOIN until GROUP BY user_id),
{_mode_cte('m_canal', 'moves', 'tipo_operacion', 'canal_moda')},
{_mode_cte('m_cat', 'held', 'producto', 'categoria_mcc_moda')},
{_mode_cte('m_input', 'talks', 'input', 'input')},
{_mode_cte('m_disp', 'talks', 'dispositivo', 'dispositivo_moda')},
features AS (
  SELECT c.user_id, c.edad, c.estado, c.ciudad, c.ingreso_mensual_mxn, c.dias_desde_ultimo_login,
         c.satisfaccion_1_10, c.num_productos_activos, c.es_hey_pro, c.UsuarioChurn,
         {_turn(['F', 'M'], 'c.user_id')} AS sexo,
         {_turn(['Preparatoria', 'Licenciatura', 'Posgrado'], 'c.user_id')} AS nivel_educativo,
         {_turn(['Empleado', 'Independiente', 'Estudiante', 'Jubilado', 'Empresario'], 'c.user_id')} AS ocupacion,
         {_turn(['App', 'Sucursal', 'Referido'], 'c.user_id')} AS canal_apertura,
         {_turn(['App', 'Llamada', 'Chat', 'Sucursal'], 'c.user_id')} AS preferencia_canal,
         {", ".join(f"coalesce(pf.{v}, false) AS {v}" for v in _PRODUCTS)},
         {", ".join(f"coalesce(oft.{v}, false) AS {v}" for v in _OPERATIONS)},
         st.monto_promedio, st.monto_min, st.monto_max, sa.saldo_promedio,
         {days_between('st.primera', 'u.until')} AS antiguedad_dias,
         {days_between('st.ultima', 'u.until')} AS dias_sin_tx,
         mc.canal_moda, mt.categoria_mcc_moda, mi.input, md.dispositivo_moda
  FROM clients c
  LEFT JOIN pflags pf ON c.user_id = pf.user_id
  LEFT JOIN oflags oft ON c.user_id = oft.user_id
  LEFT JOIN tx_stats st ON c.user_id = st.user_id
  LEFT JOIN saldos sa ON c.user_id = sa.user_id
  CROSS JOIN until u
  LEFT JOIN m_canal mc ON c.user_id = mc.user_id
  LEFT JOIN m_cat mt ON c.user_id = mt.user_id
  LEFT JOIN m_input mi ON c.user_id = mi.user_id
  LEFT JOIN m_disp md ON c.user_id = md.user_id)"""

FEATURES_BASE = with_ctes(CLIENTS, FEATURE_CTES)
_NULLABLE_FEATURES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("dias_desde_ultimo_login", "antiguedad_dias"))


def client_search_indexed(term: str) -> str:
    return f"""{BASE_CLIENTS}
SELECT user_id, estado, ciudad, edad FROM clients
WHERE contains(lower(CAST(user_id AS VARCHAR)), lower('{term}')) OR coalesce(contains(lower(ciudad), lower('{term}')), false)"""


def client_regex_indexed(pattern: str) -> str:
    return f"""{BASE_CLIENTS}
SELECT user_id, estado, ciudad, edad FROM clients WHERE coalesce(regexp_matches(ciudad, '(?i){pattern}'), false)"""


def feature_table() -> str:
    return f"""{FEATURES_BASE}
SELECT * REPLACE ({_NULLABLE_FEATURES}, CAST(dias_sin_tx AS DOUBLE) AS dias_sin_tx) FROM features"""


def monthly_balances() -> str:
    """Each month's share of every holding interval, summed."""
    return f"""WITH {MOVES},
firsts AS (SELECT user_id, date_trunc('month', min(t)) AS m0, min(s) AS s0 FROM signed GROUP BY user_id),
months AS (
  SELECT user_id, s0, CAST(unnest(range(CAST(m0 AS TIMESTAMP), CAST(date_trunc('month', until) AS TIMESTAMP) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS TIMESTAMP) AS m
  FROM firsts CROSS JOIN until),
spans AS (
  SELECT user_id, m, CAST(floor(epoch_us(m) / 1000000) AS BIGINT) AS ms, greatest(s0, CAST(floor(epoch_us(m) / 1000000) AS BIGINT)) AS a,
         least(until_s, CAST(floor(epoch_us(m + INTERVAL 1 MONTH) / 1000000) AS BIGINT)) AS b, CAST(floor(epoch_us(m + INTERVAL 1 MONTH) / 1000000) AS BIGINT) AS me
  FROM months CROSS JOIN until),
parts AS (
  SELECT sp.user_id, sp.m, CAST(sum(CAST(r.bal AS HUGEINT) * greatest(least(r.nxt, sp.b) - greatest(r.s, sp.a), 0)) AS BIGINT) AS area,
         CAST(sum(CASE WHEN r.s < sp.ms THEN r.c ELSE 0 END) AS BIGINT) AS opening,
         CAST(sum(CASE WHEN r.s < sp.me THEN r.c ELSE 0 END) AS BIGINT) AS closing,
         CAST(sum(CASE WHEN r.s >= sp.ms AND r.s < sp.me THEN 1 ELSE 0 END) AS BIGINT) AS movimientos, any_value(sp.b - sp.a) AS secs
  FROM spans sp JOIN running r ON r.user_id = sp.user_id GROUP BY sp.user_id, sp.m)
SELECT user_id, strftime(m, '%Y-%m') AS mes, CAST(opening AS DOUBLE) / {dbl(100)} AS saldo_inicial,
       CASE WHEN secs > 0 THEN CAST(area AS DOUBLE) / CAST(secs AS DOUBLE) ELSE CAST(closing AS DOUBLE) END / {dbl(100)} AS saldo_medio,
       CAST(closing AS DOUBLE) / {dbl(100)} AS saldo_final, movimientos
FROM parts"""


def aligned_upload() -> str:
    return f"""{FEATURES_BASE}
SELECT * REPLACE ({_NULLABLE_FEATURES}) FROM (SELECT user_id, {_ALIGNED} FROM features) a"""


def _scored_upload() -> str:
    login = "coalesce(CAST(dias_desde_ultimo_login AS BIGINT), 0)"
    prods = "coalesce(CAST(num_productos_activos AS BIGINT), 0)"
    score = f"""round_even(
      least(greatest({login}, 0), 90) / {dbl(90)} * {dbl(35)}
    + ({dbl(10)} - coalesce(CAST(satisfaccion_1_10 AS DOUBLE), {dbl(5)})) / {dbl(9)} * {dbl(25)}
    + ({dbl(5)} - least(greatest({prods}, 0), 5)) / {dbl(5)} * {dbl(20)}
    + least(greatest(coalesce(dias_sin_tx, 90), 0), 90) / {dbl(90)} * {dbl(20)}, 1)"""
    return f"""{FEATURES_BASE},
aligned AS (SELECT user_id, dias_sin_tx, {_ALIGNED} FROM features),
proba AS (SELECT *, {score} / {dbl(100)} AS proba FROM aligned),
scored AS (
  SELECT user_id, edad, num_productos_activos, satisfaccion_1_10, ingreso_mensual_mxn,
         CAST(trunc(proba * {dbl(100)}) AS INTEGER) AS prob_churn, ciudad,
         CAST(proba >= {dbl(0.5)} AS INTEGER) AS pred_churn
  FROM proba)"""


def upload_report() -> str:
    """The clients without city and transactions: no days without transactions count as 90."""
    return f"""{BASE_CLIENTS},
proba AS (SELECT *, round_even(
      least(greatest(coalesce(dias_desde_ultimo_login, 0), 0), 90) / {dbl(90)} * {dbl(35)}
    + ({dbl(10)} - coalesce(satisfaccion_1_10, {dbl(5)})) / {dbl(9)} * {dbl(25)}
    + ({dbl(5)} - least(greatest(num_productos_activos, 0), 5)) / {dbl(5)} * {dbl(20)}
    + {dbl(20)}, 1) / {dbl(100)} AS proba FROM clients)
SELECT CAST(user_id AS INTEGER) AS user_id, CAST(edad AS INTEGER) AS edad,
       CAST(num_productos_activos AS INTEGER) AS num_productos_activos, satisfaccion_1_10, ingreso_mensual_mxn,
       CAST(trunc(proba * {dbl(100)}) AS INTEGER) AS prob_churn, 'SIN REGISTRO' AS ciudad,
       CAST(proba >= {dbl(0.5)} AS INTEGER) AS pred_churn
FROM proba"""


def upload_without_ids() -> str:
    """The report over the clients in the order of their ids, named by their place."""
    return f"""{BASE_CLIENTS},
placed AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS place FROM clients),
proba AS (SELECT *, round_even(
      least(greatest(coalesce(dias_desde_ultimo_login, 0), 0), 90) / {dbl(90)} * {dbl(35)}
    + ({dbl(10)} - coalesce(satisfaccion_1_10, {dbl(5)})) / {dbl(9)} * {dbl(25)}
    + ({dbl(5)} - least(greatest(num_productos_activos, 0), 5)) / {dbl(5)} * {dbl(20)}
    + {dbl(20)}, 1) / {dbl(100)} AS proba FROM placed)
SELECT 'N-' || CAST(place AS VARCHAR) AS user_id, CAST(edad AS INTEGER) AS edad,
       CAST(num_productos_activos AS INTEGER) AS num_productos_activos, satisfaccion_1_10, ingreso_mensual_mxn,
       CAST(trunc(proba * {dbl(100)}) AS INTEGER) AS prob_churn, ciudad, CAST(proba >= {dbl(0.5)} AS INTEGER) AS pred_churn
FROM proba"""


KPI_DAYS = """WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS i,
         count(o_totalprice) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS m FROM orders GROUP BY 1, 2)"""


def kpi_file_report() -> str:
    return f"""{KPI_DAYS}
SELECT 'leidas' AS estado, count(*) AS filas FROM days
UNION ALL SELECT 'linea_corrupta', count(*) FILTER (i % 11 = 0) FROM days
UNION ALL SELECT 'mes_invalido', count(*) FILTER (i % 11 <> 0 AND i % 7 = 0) FROM days
UNION ALL SELECT 'valida', count(*) FILTER (i % 11 <> 0 AND i % 7 <> 0) FROM days"""


def kpi_file_months() -> str:
    return f"""{KPI_DAYS}
SELECT strftime(d, '%Y-%m') AS mes, CAST(sum(m) AS DOUBLE) AS monto_total, CAST(sum(n) AS BIGINT) AS num_transacciones,
       CAST(sum(n % 5) AS BIGINT) AS nuevos_churn FROM days WHERE i % 11 <> 0 AND i % 7 <> 0 GROUP BY 1"""


def written_clients() -> str:
    return f"""{BASE_CLIENTS}
SELECT * REPLACE (CAST(dias_desde_ultimo_login AS DOUBLE) AS dias_desde_ultimo_login) FROM clients"""


def churn_model_predictions() -> str:
    """The stored model's trees as SQL; features that are missing count as 0."""
    from ..operators.trees import stored

    proba = stored().sql(lambda c: f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE))")
    return f"""{FEATURES_BASE},
proba AS (SELECT user_id, {proba} AS p FROM features)
SELECT user_id, round(p, 9) AS probabilidad, CAST(trunc(p * {dbl(100)}) AS INTEGER) AS prob_churn,
       CAST(p >= {dbl(0.5)} AS INTEGER) AS pred_churn FROM proba"""


def churn_model_summary() -> str:
    return f"""{BASE_CLIENTS}
SELECT CASE WHEN substr(md5(CAST(user_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3')
            THEN 'prueba' ELSE 'entrenamiento' END AS conjunto,
       count(*) AS clientes, CAST(sum(CAST(UsuarioChurn = 'CHURN' AS BIGINT)) AS BIGINT) AS churn,
       count(*) AS con_probabilidad, true AS mejor_que_azar
FROM clients GROUP BY 1"""


def score_card_client(user_id: int) -> str:
    return f"{score_card()} WHERE user_id = {user_id}"


def one_client_transactions(user_id: int, page: int, page_size: int) -> str:
    return f"""WITH {TRANSACTIONS},
mine AS (SELECT * FROM transactions WHERE user_id = {user_id})
SELECT user_id, monto, strftime(fecha_hora, '%Y-%m-%d %H:%M:%S') AS fecha_hora, tipo_operacion,
       (SELECT count(*) FROM mine) AS total, {page} AS page, {page_size} AS page_size,
       CAST(ceil((SELECT count(*) FROM mine) / {page_size}) AS BIGINT) AS pages
FROM mine ORDER BY mine.fecha_hora DESC, monto DESC, tipo_operacion LIMIT {page_size} OFFSET {(page - 1) * page_size}"""


def one_client_conversations(user_id: int) -> str:
    return f"""WITH {CONVERSATIONS}
SELECT user_id, strftime(date, '%Y-%m-%d %H:%M:%S.%f') AS date, input, event_id, count(*) OVER () AS total
FROM conv WHERE user_id = {user_id}"""


def income_sample_split(n: int, seed: int) -> str:
    return f"""SELECT *, CASE WHEN status = 'CHURN' THEN 'churn' ELSE 'no churn' END AS serie
FROM ({income_sample(n, seed)}) s"""


def batch_report_table(k: int) -> str:
    return f"{_scored_upload()}\nSELECT * FROM scored ORDER BY prob_churn DESC, user_id LIMIT {k}"


def batch_report_cities(k: int) -> str:
    return f"""{_scored_upload()}
SELECT ciudad, avg(prob_churn) AS prob_churn FROM scored GROUP BY ciudad
ORDER BY prob_churn DESC, ciudad LIMIT {k}"""


def batch_report_summary() -> str:
    return f"""{_scored_upload()}
SELECT count(*) AS total_registros, avg(prob_churn) AS promedio_churn,
       {dbl(100)} - avg(prob_churn) AS promedio_retencion FROM scored"""


def batch_report_scatter() -> str:
    return f"{_scored_upload()}\nSELECT ingreso_mensual_mxn, prob_churn FROM scored"


def monthly_rollup_stream() -> str:
    return f"""WITH {TRANSACTIONS}, {CONVERSATIONS},
rows AS (
  SELECT CAST(date_trunc('month', fecha_hora) AS DATE) AS mes, CAST(round(monto * {dbl(100)}) AS BIGINT) AS cents,
         1 AS is_tx, 0 AS is_input FROM transactions
  UNION ALL
  SELECT CAST(date_trunc('month', date) AS DATE), CAST(NULL AS BIGINT), 0, 1 FROM conv)
SELECT strftime(mes, '%Y-%m') AS mes, coalesce(CAST(sum(cents) AS DOUBLE) / {dbl(100)}, {dbl(0)}) AS monto_total,
       CAST(sum(is_tx) AS BIGINT) AS num_transacciones, CAST(sum(is_input) AS BIGINT) AS num_inputs
FROM rows GROUP BY mes"""


def kpi_unparseable_months() -> str:
    return f"""{BASE_KPI}
SELECT count(CASE WHEN mes IS NULL THEN 1 END) AS filas_descartadas FROM kpi"""


def top_conversation_inputs_by_month(k: int) -> str:
    return f"""WITH {CONVERSATIONS},
inputs AS (SELECT date AS fecha, input FROM conv),
{TOP_INPUTS.format(k=k).strip()}
SELECT strftime(month, '%Y-%m') AS month, input, count FROM top_inputs"""


def conversation_inputs_pivot(k: int, values: list[str]) -> str:
    cells = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN input = '{v}' THEN count END), 0) AS BIGINT) AS \"{v}\"" for v in values)
    listed = ", ".join(f"'{v}'" for v in values)
    cells += f", CAST(coalesce(sum(CASE WHEN input IN ({listed}) THEN 0 ELSE count END), 0) AS BIGINT) AS otros"
    return f"""WITH {CONVERSATIONS},
inputs AS (SELECT date AS fecha, input FROM conv),
{TOP_INPUTS.format(k=k).strip()}
SELECT strftime(month, '%Y-%m') AS mes_clave, {_month_label('month')} AS mes, {cells}
FROM top_inputs GROUP BY month ORDER BY mes_clave"""


def all_sql() -> dict[str, str]:
    from . import params as P

    return {
        "churn_scores": churn_scores(),
        "search_clients": search_clients(P.SEARCH_Q, P.SEARCH_LIMIT),
        "high_risk_page": high_risk_page(**P.HIGH_RISK_PAGE),
        "high_risk_page_state": high_risk_page(**P.HIGH_RISK_PAGE_STATE),
        "high_risk_deep_page": indexed_page(**P.DEEP_PAGE),
        "high_risk_page_past_end": indexed_page(**P.PAST_END_PAGE),
        "high_risk_after": high_risk_after(**P.HIGH_RISK_AFTER),
        "client_transactions": transaction_pages(**P.TX_PAGE_FIRST),
        "client_transactions_page2": transaction_pages(**P.TX_PAGE_SECOND),
        "client_conversations": conversation_histories(),
        "score_card": score_card(),
        "high_risk_top": high_risk_top(P.HIGH_RISK_TOP_K),
        "monthly_kpis": monthly_kpis(),
        "monthly_kpis_incremental": monthly_kpis(),
        "months": months(),
        "global_kpis": global_kpis(P.GLOBAL_KPI_MONTH),
        "global_kpis_first_month": global_kpis(P.GLOBAL_KPI_FIRST_MONTH),
        "kpi_changes": kpi_changes(),
        "churn_timeline": churn_timeline(),
        "kpi_unparseable_months": kpi_unparseable_months(),
        "churn_label_counts": churn_label_counts(),
        "churn_counts": churn_counts(),
        "churn_totals": churn_totals(),
        "state_map": state_map(),
        "age_profile": age_profile(),
        "product_usage_table": product_usage_table(),
        "product_usage": product_usage(P.TOP_PRODUCTS),
        "income_sample": income_sample(P.SAMPLE_ROWS, P.SAMPLE_SEED),
        "region_match": region_match(),
        "state_lookup": state_lookup(),
        "top_inputs_by_month": top_inputs_by_month(P.TOP_PER_MONTH),
        "top_conversation_inputs_by_month": top_conversation_inputs_by_month(P.TOP_PER_MONTH),
        "top_operations_by_month": top_operations_by_month(P.TOP_PER_MONTH),
        "inputs_pivot": inputs_pivot(P.TOP_PER_MONTH, P.INPUT_VALUES),
        "conversation_inputs_pivot": conversation_inputs_pivot(P.TOP_PER_MONTH, P.CONVERSATION_INPUT_VALUES),
        "operations_pivot": operations_pivot(P.TOP_PER_MONTH, P.OPERATION_VALUES),
        "retention_actions": retention_actions(),
        "action_messages": action_messages(),
        "high_risk_search": high_risk_search(P.HIGH_RISK_SEARCH_TERM, P.HIGH_RISK_SEARCH_ROWS),
        "client_search_indexed": client_search_indexed(P.INDEXED_SEARCH_TERM),
        "client_regex_indexed": client_regex_indexed(P.INDEXED_SEARCH_REGEX),
        "feature_table": feature_table(),
        "monthly_balances": monthly_balances(),
        "aligned_upload": aligned_upload(),
        "batch_report_table": batch_report_table(P.REPORT_TOP_ROWS),
        "batch_report_cities": batch_report_cities(P.REPORT_TOP_CITIES),
        "batch_report_summary": batch_report_summary(),
        "batch_report_scatter": batch_report_scatter(),
        "monthly_rollup_stream": monthly_rollup_stream(),
        "churn_model_summary": churn_model_summary(),
        "churn_model_predictions": churn_model_predictions(),
        "score_card_client": score_card_client(P.CLIENT_ID),
        "one_client_transactions": one_client_transactions(P.CLIENT_ID, **P.CLIENT_TX_PAGE),
        "one_client_conversations": one_client_conversations(P.CLIENT_ID),
        "income_sample_split": income_sample_split(P.SAMPLE_ROWS, P.SAMPLE_SEED),
        "upload_report": upload_report(),
        "upload_without_ids": upload_without_ids(),
        "kpi_file_report": kpi_file_report(),
        "kpi_file_months": kpi_file_months(),
        "written_clients": written_clients(),
    }
