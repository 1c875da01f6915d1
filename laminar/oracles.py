"""DuckDB SQL for the catalogue, written apart from the engine: plain predicates, windows and joins over the same relations."""

from __future__ import annotations

from laminar.sources.adapters import FIRST_DAY, HIGH_VALUE, INACTIVE_DAYS, entity_sql

_RAW = {"customers": "raw_c", "products": "raw_p", "orders": "raw_o"}
_KEY = {"customers": "customer_id", "products": "product_id", "orders": "order_id"}
_DELETED = {"customers": 41, "products": 37, "orders": 43}
_COLUMNS = {
    "customers": ["customer_id", "customer_name", "email", "country", "signup_date", "customer_segment", "lifetime_value"],
    "products": ["product_id", "product_name", "category", "price", "cost", "stock_quantity", "reorder_level"],
    "orders": ["order_id", "customer_id", "order_date", "product_id", "quantity", "unit_price", "total_amount", "order_status", "payment_date"],
}
_EVENT = {"customers": "signup_date", "products": None, "orders": "order_date"}
_MAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"

#: (category, rule, column, what is wrong) per entity
_WRONG = {
    "customers": [
        ("type_logic", "format_email", "email", f"NOT regexp_matches(email, {_MAIL})"),
        ("type_logic", "min_length", "customer_name", "length(customer_name) < 2"),
        ("type_logic", "max_length", "customer_name", "length(customer_name) > 100"),
        ("type_logic", "pattern", "country", "NOT regexp_matches(country, '^[A-Za-z .''-]{2,56}$')"),
        ("type_logic", "enum", "customer_segment", "customer_segment NOT IN ('Premium', 'Standard', 'Basic')"),
        ("type_logic", "max_date", "signup_date", "signup_date > current_date"),
        ("type_logic", "minimum", "lifetime_value", "lifetime_value < 0"),
        ("completeness", "not_null", "customer_id", "customer_id IS NULL"),
        ("uniqueness", "uniqueness", "customer_id", "many > 1"),
        ("completeness", "not_null", "email", "email IS NULL"),
    ],
    "products": [
        ("type_logic", "minimum", "price", "price < 0"),
        ("type_logic", "minimum", "cost", "cost < 0"),
        ("type_logic", "max_length", "product_name", "length(product_name) > 200"),
        ("type_logic", "minimum", "stock_quantity", "stock_quantity < 0"),
        ("type_logic", "maximum", "stock_quantity", "stock_quantity > 100000"),
        ("completeness", "not_null", "product_id", "product_id IS NULL"),
        ("uniqueness", "uniqueness", "product_id", "many > 1"),
    ],
    "orders": [
        ("type_logic", "minimum", "quantity", "quantity < 1"),
        ("type_logic", "maximum", "quantity", "quantity > 1000"),
        ("type_logic", "exclusive_minimum", "unit_price", "unit_price <= 0"),
        ("type_logic", "min_date", "order_date", f"order_date < DATE '{FIRST_DAY}'"),
        ("type_logic", "max_date", "order_date", "order_date > current_date"),
        ("type_logic", "minimum", "total_amount", "total_amount < 0"),
        ("type_logic", "enum", "order_status", "order_status NOT IN ('Pending', 'Completed', 'Cancelled')"),
        ("completeness", "not_null", "order_id", "order_id IS NULL"),
        ("completeness", "not_null", "customer_id", "customer_id IS NULL"),
        ("completeness", "not_null", "product_id", "product_id IS NULL"),
        ("uniqueness", "uniqueness", "order_id", "many > 1"),
        ("referential", "fk_exists", "customer_id", "customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM silver_c WHERE NOT is_deleted)"),
        ("referential", "fk_exists", "product_id", "product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM silver_p WHERE NOT is_deleted)"),
    ],
}
_S = {"customers": "c", "products": "p", "orders": "o"}


def _hash(entity: str) -> str:
    return "sha256(concat_ws('||', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _COLUMNS[entity]) + "))"


def _ranks(entity: str, scope: str, more: str = "") -> str:
    event = f"{_EVENT[entity]} DESC NULLS LAST, " if _EVENT[entity] else ""
    return f"CAST(row_number() OVER (PARTITION BY {scope} ORDER BY delivered DESC NULLS LAST, _batch_id DESC NULLS LAST, {event}_ingest_timestamp DESC NULLS LAST, h DESC NULLS LAST{more}) AS INT)"


def _any(entity: str, *categories: str) -> str:
    return " OR ".join(f"coalesce({w}, FALSE)" for c, _, _, w in _WRONG[entity] if c in categories) or "FALSE"


def _entity(entity: str, rows: str | None = None, suffix: str = "") -> list[str]:
    """CTEs: val_x (rows with their ranks and faults) and silver_x (conformed)."""
    s, k = _S[entity], _KEY[entity]
    cols = ", ".join(_COLUMNS[entity])
    base = f"(SELECT * FROM raw_{s} {rows or ''})"
    return [
        f"""val_{s}{suffix} AS (SELECT *, {_ranks(entity, k, ", delivery_rank")} AS pk_rank,
              ({_any(entity, "completeness", "type_logic")}) AS bad, ({_any(entity, "referential")}) AS orphan
            FROM (SELECT *, {_ranks(entity, k + ", _batch_id")} AS delivery_rank
              FROM (SELECT *, count(*) OVER (PARTITION BY {k}, _batch_id) AS many, max(_ingest_timestamp) OVER (PARTITION BY _batch_id) AS delivered, {_hash(entity)} AS h FROM {base} q) q) q)""",
        f"silver_{s}{suffix} AS (SELECT {cols}, h, coalesce({k} % {_DELETED[entity]} = 0, FALSE) AS is_deleted, orphan AS is_orphan, _batch_id AS batch_id FROM val_{s}{suffix} WHERE pk_rank = 1 AND delivery_rank = 1 AND NOT bad)",
    ]


_CTES = [f"raw_{_S[e]} AS ({entity_sql(e, lambda t: t)})" for e in _S] + [x for e in _S for x in _entity(e)]


def _cents(total: str, n: str) -> str:
    """total / n, half a cent rounded away from zero, through whole cents."""
    return f"CAST(sign({total}) * ((2 * CAST(abs({total}) * 100 AS HUGEINT) + {n}) // (2 * nullif({n}, 0))) / 100.0 AS DECIMAL(18,2))"


_CTES += [
    "q AS (SELECT order_id, customer_id, product_id, order_date, total_amount FROM silver_o WHERE order_status = 'Completed' AND NOT is_orphan AND NOT is_deleted)",
    f"""sales AS (SELECT p.product_id, p.product_name, p.category, CAST(count(q.order_id) AS BIGINT) AS total_orders, CAST(coalesce(sum(q.total_amount), 0) AS DECIMAL(18,2)) AS total_revenue,
          {_cents("sum(q.total_amount)", "count(q.order_id)")} AS avg_order_value
        FROM silver_p p LEFT JOIN q ON q.product_id = p.product_id WHERE NOT p.is_deleted GROUP BY ALL)""",
    f"""revenue AS (SELECT c.customer_id, c.customer_name, c.customer_segment, CAST(count(q.order_id) AS BIGINT) AS total_orders, CAST(coalesce(sum(q.total_amount), 0) AS DECIMAL(18,2)) AS total_revenue,
          {_cents("sum(q.total_amount)", "count(q.order_id)")} AS avg_order_value, CAST(coalesce(sum(q.total_amount), 0) AS DECIMAL(18,2)) AS lifetime_value_actual, max(q.order_date) AS last_order_date
        FROM silver_c c LEFT JOIN q ON q.customer_id = c.customer_id WHERE NOT c.is_deleted GROUP BY c.customer_id, c.customer_name, c.customer_segment)""",
    f"""days AS (SELECT order_date, CAST(date_trunc('week', order_date) AS DATE) AS week_start, CAST(count(*) AS BIGINT) AS total_orders, CAST(sum(total_amount) AS DECIMAL(18,2)) AS total_revenue,
          {_cents("sum(total_amount)", "count(*)")} AS avg_order_value FROM q GROUP BY order_date)""",
    f"""labels_ AS (SELECT r.*, CASE WHEN last_order_date IS NULL OR last_order_date < (SELECT max(last_order_date) FROM revenue) - {INACTIVE_DAYS} THEN 'Inactive'
          WHEN lifetime_value_actual >= {HIGH_VALUE} THEN 'High-Value' WHEN total_orders >= 2 THEN 'Repeat' ELSE 'One-Time' END AS segment_type FROM revenue r)""",
    f"""segments AS (SELECT segment_type, CAST(count(*) AS BIGINT) AS customer_count, {_cents("sum(total_revenue)", "count(*)")} AS avg_revenue, CAST(sum(total_revenue) AS DECIMAL(18,2)) AS total_revenue
        FROM labels_ GROUP BY segment_type)""",
    "stale AS (SELECT * REPLACE (CASE WHEN order_id % 31 = 0 THEN NOT is_orphan ELSE is_orphan END AS is_orphan) FROM silver_o)",
    """fresh AS (SELECT order_id, is_orphan AS was, (customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM silver_c WHERE NOT is_deleted))
          OR (product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM silver_p WHERE NOT is_deleted)) AS now FROM stale)""",
    *_entity("orders", "WHERE _batch_id = 'b1'", "1"),
    *_entity("orders", "WHERE _batch_id = 'b2'", "2"),
    "t1 AS (SELECT * REPLACE (CASE WHEN order_id % 19 <> 0 THEN h END AS h, order_id % 17 = 0 AS is_deleted) FROM silver_o1)",
    "t2 AS (SELECT * REPLACE (FALSE AS is_deleted) FROM silver_o2)",
    """acts AS (SELECT coalesce(t.order_id, s.order_id) AS order_id, CASE WHEN t.order_id IS NULL THEN 'insert' WHEN s.order_id IS NULL THEN 'keep'
          WHEN t.h IS NULL OR t.h <> s.h OR t.is_deleted OR t.is_orphan IS DISTINCT FROM s.is_orphan THEN 'update' ELSE 'keep' END AS action
        FROM t1 t FULL JOIN t2 s ON t.order_id = s.order_id)""",
]


def _sql(body: str) -> str:
    return "WITH " + ",\n".join(_CTES) + "\n" + body


def _list(entity: str, rules: list[tuple[str, str, str, str]], source: str | None = None, shown: str = "category, rule, col, value") -> str:
    s, k = _S[entity], _KEY[entity]
    parts = [f"SELECT {k}, '{c}' AS category, '{r}' AS rule, '{col}' AS col, CAST({col} AS VARCHAR) AS value FROM {source or 'val_' + s} WHERE {w}" for c, r, col, w in rules]
    columns = ", ".join('col AS "column"' if c == "col" else c for c in shown.split(", "))
    return _sql(f"SELECT {k}, {columns} FROM ({' UNION ALL '.join(parts)}) v")


def _rule(entity: str, *columns: str, rules: tuple[str, ...] = (), shown: str = "rule, col, value") -> str:
    picked = [x for x in _WRONG[entity] if x[0] == "type_logic" and x[2] in columns and (not rules or x[1] in rules)]
    return _list(entity, picked, shown=shown)


def _own(entity: str, rule: str, column: str, wrong: str, source: str | None = None, shown: str = "rule, col, value") -> str:
    return _list(entity, [("x", rule, column, wrong)], source, shown)


def _metrics(entity: str) -> str:
    parts = []
    for c in ("completeness", "type_logic", "uniqueness", "referential"):
        parts.append(f"SELECT '{c}' AS check_category, count(*) AS n, coalesce(sum(CASE WHEN {_any(entity, c)} THEN 1 ELSE 0 END), 0) AS f FROM val_{_S[entity]}")
    return _sql(f"""SELECT '{entity}' AS entity_name, check_category, CAST(n AS BIGINT) AS rows_evaluated, CAST(n - f AS BIGINT) AS rows_passed, CAST(f AS BIGINT) AS rows_quarantined,
        CASE WHEN n > 0 THEN round(CAST(n - f AS DOUBLE) / n * 100, 4) ELSE 0.0 END AS pass_pct FROM ({" UNION ALL ".join(parts)}) m""")


def _count(name: str, body: str) -> str:
    return _sql(f"SELECT CAST(count(*) AS BIGINT) AS {name} FROM ({body}) x")


_TRENDS = "SELECT order_date, week_start, total_orders, total_revenue, avg_order_value FROM days"
_TOP = "SELECT * FROM sales ORDER BY total_revenue DESC, product_id LIMIT 10"
_SHOW = "SELECT order_id, _batch_id AS batch_id, h AS row_hash FROM val_o WHERE"
_REJECT = "(bad OR delivery_rank > 1)"


def _wave(body: str) -> str:
    """Over the tables as two waves leave them: orders of the second delivery stand in for those of the first."""
    cols = ", ".join(_COLUMNS["orders"])
    ctes = [
        *_CTES,
        f"wave_o AS (SELECT {cols}, h, is_orphan FROM silver_o2 UNION ALL SELECT {cols}, h, is_orphan FROM silver_o1 WHERE order_id NOT IN (SELECT order_id FROM silver_o2))",
        "wave_q AS (SELECT * FROM wave_o WHERE order_status = 'Completed' AND NOT is_orphan)",
        *[f"twice_{s} AS (SELECT *, 0 AS wave FROM val_{s} UNION ALL SELECT *, 1 FROM val_{s} WHERE {_KEY[e]} % {_DELETED[e]} <> 0)" for e, s in _S.items() if e != "orders"],
        "twice_o AS (SELECT *, 0 AS wave FROM val_o1 UNION ALL SELECT *, 1 FROM val_o2)",
    ]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _wave_metrics() -> str:
    parts = []
    for e, s in _S.items():
        for c in ("completeness", "type_logic", "uniqueness", "referential"):
            if c == "referential" and e == "orders":  # parents were all there when the first orders came, and some were gone when the second did
                lost = " OR ".join(f"({k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM silver_{p} z WHERE z.{k} = y.{k} AND (wave = 0 OR NOT z.is_deleted)))" for k, p in (("customer_id", "c"), ("product_id", "p")))
                parts.append(f"SELECT '{e}' AS entity_name, '{c}' AS check_category, count(*) AS n, count(*) FILTER ({lost}) AS f FROM twice_{s} y")
            else:
                parts.append(f"SELECT '{e}' AS entity_name, '{c}' AS check_category, count(*) AS n, count(*) FILTER ({_any(e, c)}) AS f FROM twice_{s}")
    return _wave(f"SELECT entity_name, check_category, CAST(n AS BIGINT) AS evaluated, CAST(f AS BIGINT) AS quarantined FROM ({' UNION ALL '.join(parts)}) m")


_LANDED = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, CAST(wave AS BIGINT) AS version, '{'incremental' if e == 'orders' else 'full_snapshot'}' AS delivery, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS batches FROM twice_{s} GROUP BY wave" for e, s in _S.items()
)


#: The declared constraints (fixed values).
_RULES = """
SELECT * FROM (VALUES
 ('customers', 'email', 'format', 'email'), ('customers', 'customer_name', 'min_length', '2'), ('customers', 'customer_name', 'max_length', '100'),
 ('customers', 'country', 'pattern', '^[A-Za-z .''-]{2,56}$'), ('customers', 'customer_segment', 'enum', 'Premium|Standard|Basic'),
 ('customers', 'signup_date', 'max_date', 'today'), ('customers', 'lifetime_value', 'minimum', '0'),
 ('customers', 'customer_id', 'not_null', ''), ('customers', 'customer_id', 'uniqueness', ''), ('customers', 'email', 'not_null', ''),
 ('products', 'price', 'minimum', '0'), ('products', 'cost', 'minimum', '0'), ('products', 'product_name', 'max_length', '200'),
 ('products', 'stock_quantity', 'minimum', '0'), ('products', 'stock_quantity', 'maximum', '100000'),
 ('products', 'product_id', 'not_null', ''), ('products', 'product_id', 'uniqueness', ''),
 ('orders', 'quantity', 'minimum', '1'), ('orders', 'quantity', 'maximum', '1000'), ('orders', 'unit_price', 'exclusive_minimum', '0'),
 ('orders', 'order_date', 'min_date', '2020-01-01'), ('orders', 'order_date', 'max_date', 'today'), ('orders', 'total_amount', 'minimum', '0'),
 ('orders', 'order_status', 'enum', 'Pending|Completed|Cancelled'), ('orders', 'order_id', 'not_null', ''), ('orders', 'customer_id', 'not_null', ''),
 ('orders', 'product_id', 'not_null', ''), ('orders', 'order_id', 'uniqueness', ''), ('orders', 'customer_id', 'fk_exists', 'customers.customer_id'),
 ('orders', 'product_id', 'fk_exists', 'products.product_id')) AS r(source_name, col, rule, value)
"""


def oracle_sql() -> dict[str, str]:
    o = "orders"
    return {
        "dq_rules_loaded": _RULES,
        "bronze_ingest_metadata": _sql("SELECT product_id, 'products.csv' AS _source_file, 'batch-1' AS _batch_id, 'full_snapshot' AS _delivery_pattern, CAST(NULL AS VARCHAR) AS _rescued_data, '2024-02-01 00:00:00' AS ingested FROM raw_p"),
        "row_hash": _sql(f"SELECT order_id, {_hash(o)} AS row_hash FROM raw_o"),
        "row_hash_customers": _sql(f"SELECT customer_id, {_hash('customers')} AS row_hash FROM raw_c"),
        "filter_in_like": _sql("SELECT customer_id, email, lifetime_value FROM raw_c WHERE customer_segment IN ('Premium', 'Standard') AND email LIKE 'c1%' AND lifetime_value BETWEEN 0 AND 5000"),
        "distinct_keys": _sql("SELECT DISTINCT customer_id AS k FROM silver_c WHERE NOT is_deleted"),
        "count_filtered": _sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (_batch_id = 'b2') AS BIGINT) AS second FROM raw_o"),
        "ops_rows_per_batch": _sql("SELECT _batch_id AS batch_id, order_status, CAST(count(*) AS BIGINT) AS n FROM raw_o GROUP BY ALL ORDER BY n DESC, batch_id, order_status LIMIT 10"),
        "ops_rows_per_file": _sql("SELECT 'orders_' || strftime(order_date, '%Y-%m') || '.csv' AS source_file, CAST(count(*) AS BIGINT) AS n FROM raw_o GROUP BY ALL ORDER BY n DESC, source_file LIMIT 10"),
        "ops_rows_since": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts >= epoch_ms(1706500000000 - 60000) GROUP BY ALL",
        "recent_window_filter": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOURS",
        "dq_not_null": _own("customers", "not_null", "email", "email IS NULL", shown="rule, col"),
        "dq_string_length": _rule("customers", "customer_name"),
        "dq_pattern": _rule("customers", "country"),
        "dq_format_email": _rule("customers", "email"),
        "dq_enum": _rule(o, "order_status"),
        "dq_numeric_min": _rule("products", "price", "cost"),
        "dq_numeric_max": _rule("products", "stock_quantity"),
        "dq_exclusive_min": _rule(o, "unit_price"),
        "dq_exclusive_max": _own("products", "exclusive_maximum", "stock_quantity", "stock_quantity >= 400"),
        "dq_multiple_of": _own("products", "multiple_of", "price", "CAST(price * 100 AS BIGINT) % 25 <> 0"),
        "dq_numeric_coerce": _own("products", "minimum", "stock_text", "TRY_CAST(stock_text AS BIGINT) < 100", "(SELECT *, CASE WHEN product_id % 3 = 0 THEN 'n/a' ELSE CAST(stock_quantity AS VARCHAR) END AS stock_text FROM raw_p)"),
        "dq_date_min": _rule(o, "order_date", rules=("min_date",)),
        "dq_date_max_today": _rule(o, "order_date", rules=("max_date",)),
        "dq_date_parse": _own("customers", "max_date", "signup_text", "TRY_STRPTIME(signup_text, '%d/%m/%Y') > DATE '1994-06-30'", "(SELECT *, CASE WHEN customer_id % 7 = 0 THEN 'someday' ELSE strftime(signup_date, '%d/%m/%Y') END AS signup_text FROM raw_c)"),
        "dq_annotate_violations": _list(o, [x for x in _WRONG[o] if x[0] == "type_logic"]),
        "chk_not_null": _sql("SELECT order_id, 'completeness' AS category, 'not_null' AS rule, 'customer_id' AS \"column\" FROM raw_o WHERE customer_id IS NULL"),
        "chk_uniqueness": _list(o, [x for x in _WRONG[o] if x[0] == "uniqueness"]),
        "chk_fk_exists": _list(o, [x for x in _WRONG[o] if x[0] == "referential"][:1]),
        "chk_append": _list("customers", _WRONG["customers"]),
        "survivorship_rank": _sql("SELECT order_id, _batch_id AS batch_id, h AS row_hash, pk_rank FROM val_o"),
        "delivery_rank": _sql("SELECT order_id, _batch_id AS batch_id, h AS row_hash, delivery_rank FROM val_o"),
        "blocking_violations": _list(o, [x for x in _WRONG[o] if x[0] in ("type_logic", "completeness")]),
        "orphan_flag_batch": _sql("SELECT _batch_id AS batch_id, orphan AS is_orphan, CAST(count(*) AS BIGINT) AS n FROM val_o GROUP BY ALL"),
        "split_survivors": _sql(f"{_SHOW} pk_rank = 1"),
        "split_passed": _sql(f"{_SHOW} pk_rank = 1 AND NOT {_REJECT}"),
        "split_failed": _sql(f"{_SHOW} {_REJECT}"),
        "split_superseded": _sql(f"{_SHOW} pk_rank > 1 AND NOT {_REJECT}"),
        "silver_prepare_rows": _sql(f"SELECT {', '.join(_COLUMNS['customers'])}, 'PASS' AS quality_check_result, h AS row_hash, FALSE AS is_deleted, is_orphan, batch_id AS bronze_batch_id FROM silver_c"),
        "quarantine_rows": _sql(f"""SELECT 'customers' AS entity_name, coalesce(CAST(customer_id AS VARCHAR), '__NULL_PK__') AS primary_key, email, CAST({" + ".join(f"CAST(coalesce({w}, FALSE) AS INT)" for _, _, _, w in _WRONG["customers"])} AS BIGINT) AS violations,
            'run' AS silver_run_id, _batch_id AS bronze_batch_id FROM val_c WHERE {_REJECT}"""),
        "quarantine_by_category": _sql("SELECT category, CAST(count(*) AS BIGINT) AS violations FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS category FROM val_o WHERE {_REJECT} AND ({w})" for c, _, _, w in _WRONG[o]) + ") v GROUP BY category"),
        "upsert_actions": _sql("SELECT order_id, action FROM acts"),
        "upsert_result": _sql("""SELECT order_id, customer_id, total_amount, h AS row_hash, is_deleted, is_orphan, batch_id FROM t1 JOIN acts USING (order_id) WHERE action = 'keep'
            UNION ALL SELECT order_id, customer_id, total_amount, h, is_deleted, is_orphan, batch_id FROM t2 JOIN acts USING (order_id) WHERE action <> 'keep'"""),
        "soft_delete_missing": _sql("SELECT customer_id FROM silver_c WHERE NOT is_deleted AND customer_id NOT IN (SELECT customer_id FROM raw_c WHERE customer_id % 29 <> 0)"),
        "soft_delete_result": _sql("SELECT customer_id, is_deleted OR customer_id NOT IN (SELECT customer_id FROM raw_c WHERE customer_id % 29 <> 0) AS is_deleted FROM silver_c"),
        "orphan_recompute": _sql("SELECT order_id, now AS is_orphan FROM fresh"),
        "orphan_changes": _sql("SELECT order_id, was AS was_orphan, now AS is_orphan FROM fresh WHERE was IS DISTINCT FROM now"),
        "null_safe_diff": _sql("SELECT CAST(count(*) AS BIGINT) AS different FROM raw_o WHERE customer_id IS DISTINCT FROM product_id"),
        "dq_metrics_customers": _metrics("customers"),
        "dq_metrics_products": _metrics("products"),
        "dq_metrics_orders": _metrics(o),
        "ops_latest_manifest": """SELECT layer, entity_name, run_id FROM (SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS layer, CAST(user_id % 10 AS VARCHAR) AS entity_name,
            row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events) e WHERE k = 1""",
        "qualifying_orders": _sql("SELECT * FROM q"),
        "gold_input_breakdown": _sql("""SELECT CAST(count(*) AS BIGINT) AS rows_total, CAST(count(*) FILTER (order_status = 'Completed' AND NOT is_orphan AND NOT is_deleted) AS BIGINT) AS rows_qualifying,
            CAST(count(*) FILTER (order_status = 'Pending') AS BIGINT) AS rows_pending, CAST(count(*) FILTER (order_status = 'Cancelled') AS BIGINT) AS rows_cancelled,
            CAST(count(*) FILTER (is_orphan) AS BIGINT) AS rows_orphan, CAST(count(*) FILTER (is_deleted) AS BIGINT) AS rows_deleted FROM silver_o"""),
        "gold_sales_by_product": _sql("SELECT * FROM sales"),
        "gold_revenue_by_customer": _sql("SELECT * FROM revenue"),
        "gold_daily_weekly_trends": _sql(_TRENDS),
        "segment_labels": _sql("SELECT customer_id, segment_type FROM labels_"),
        "gold_customer_segmentation": _sql("SELECT * FROM segments"),
        "dash_measures": _sql("SELECT CAST(sum(total_revenue) AS DECIMAL(28,2)) AS revenue, CAST(sum(total_orders) AS BIGINT) AS orders, CAST(sum(CASE WHEN total_orders > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_customers FROM revenue"),
        "dash_top_products": _sql(_TOP),
        "dash_trends": _sql(_TRENDS + " ORDER BY order_date"),
        "dash_segments": _sql("SELECT segment_type, CAST(sum(customer_count) AS BIGINT) AS customers FROM segments GROUP BY ALL"),
        "dash_weekly_revenue": _sql("SELECT week_start AS week, CAST(sum(total_revenue) AS DECIMAL(28,2)) AS total_revenue FROM days GROUP BY ALL"),
        "dash_weekly_orders": _sql("SELECT week_start AS week, CAST(sum(total_orders) AS BIGINT) AS total_orders FROM days GROUP BY ALL"),
        "dash_active_customers": _sql("SELECT CAST(sum(CASE WHEN total_orders > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_customers FROM revenue"),
        "dash_revenue_histogram": _sql("SELECT CAST(floor(total_revenue / 1000) * 1000 AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS customers FROM revenue GROUP BY ALL"),
        "dash_filter_date": _sql(_TRENDS + " WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
        "dash_filter_category": _sql(f"SELECT product_name, category, CAST(sum(total_revenue) AS DECIMAL(28,2)) AS total_revenue FROM ({_TOP}) x GROUP BY ALL"),
        "dash_filter_segment": _sql("SELECT CAST(sum(CASE WHEN total_orders > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_customers FROM revenue WHERE customer_segment = 'Premium'"),
        "wave_bronze_landed": _wave(f"SELECT {', '.join(_COLUMNS['products'])}, CAST(NULL AS VARCHAR) AS rescued FROM twice_p"),
        "wave_bronze_batches": _wave(_LANDED),
        "wave_change_feed": _wave("SELECT order_id, 'insert' AS change_type, CAST(1 AS BIGINT) AS version FROM raw_o WHERE _batch_id = 'b2'"),
        "wave_silver_orders": _wave("SELECT order_id, customer_id, product_id, total_amount, h AS row_hash, is_orphan FROM wave_o"),
        "wave_silver_customers": _wave("SELECT customer_id, email, is_deleted FROM silver_c"),
        "wave_time_travel": _wave("SELECT customer_id, FALSE AS is_deleted FROM silver_c"),
        "wave_history": _wave("""SELECT CAST(0 AS BIGINT) AS version, 'MERGE' AS operation, CAST(count(*) AS BIGINT) AS n FROM silver_c
            UNION ALL SELECT 1, 'SOFT DELETE', count(*) FROM silver_c WHERE is_deleted"""),
        "wave_quarantine": _wave(" UNION ALL ".join(f"SELECT '{e}' AS entity_name, CAST(count(*) AS BIGINT) AS n FROM twice_{s} WHERE {_REJECT}" for e, s in _S.items())),
        "wave_dq_metrics": _wave_metrics(),
        "wave_gold_sales": _wave(f"""SELECT p.product_id, p.product_name, p.category, CAST(count(q.order_id) AS BIGINT) AS total_orders, CAST(coalesce(sum(q.total_amount), 0) AS DECIMAL(18,2)) AS total_revenue,
            {_cents("sum(q.total_amount)", "count(q.order_id)")} AS avg_order_value FROM silver_p p LEFT JOIN wave_q q ON q.product_id = p.product_id WHERE NOT p.is_deleted GROUP BY ALL"""),
        "wave_gold_revenue": _wave(f"""SELECT c.customer_id, c.customer_name, c.customer_segment, CAST(count(q.order_id) AS BIGINT) AS total_orders, CAST(coalesce(sum(q.total_amount), 0) AS DECIMAL(18,2)) AS total_revenue,
            {_cents("sum(q.total_amount)", "count(q.order_id)")} AS avg_order_value, CAST(coalesce(sum(q.total_amount), 0) AS DECIMAL(18,2)) AS lifetime_value_actual, max(q.order_date) AS last_order_date
            FROM silver_c c LEFT JOIN wave_q q ON q.customer_id = c.customer_id WHERE NOT c.is_deleted GROUP BY c.customer_id, c.customer_name, c.customer_segment"""),
        "wave_manifest": _wave("""SELECT 'bronze' AS layer, entity AS entity_name, 'success' AS status, n AS landed FROM (""" + _LANDED + """) l WHERE version = 1
            UNION ALL SELECT 'silver', entity, 'success', NULL FROM (VALUES ('customers'), ('products'), ('orders')) v(entity) UNION ALL SELECT 'gold', NULL, 'success', NULL"""),
        "recon_full_outer_diff": _sql("""SELECT CAST(count(*) FILTER (r.product_id IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (s.product_id IS NULL) AS BIGINT) AS only_right,
            CAST(count(*) FILTER (r.product_id IS NOT NULL AND s.product_id IS NOT NULL AND r.n <> s.total_orders) AS BIGINT) AS different
            FROM sales s FULL JOIN (SELECT product_id, count(*) AS n FROM q GROUP BY product_id) r ON s.product_id = r.product_id"""),
        "recon_unaccounted_keys": _count("unaccounted", f"SELECT DISTINCT customer_id FROM raw_c WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM silver_c) AND customer_id NOT IN (SELECT customer_id FROM val_c WHERE {_REJECT} AND customer_id IS NOT NULL)"),
        "recon_duplicate_keys": _count("duplicate_keys", "SELECT order_id FROM raw_o GROUP BY order_id HAVING count(*) > 1"),
        "recon_orphan_wrongly_set": _count("wrong", "SELECT 1 FROM fresh WHERE was AND NOT now"),
        "recon_orphan_wrongly_cleared": _count("wrong", "SELECT 1 FROM fresh WHERE NOT was AND now"),
        "recon_cross_foot": _sql("""SELECT (SELECT CAST(sum(total_revenue) AS DECIMAL(38,2)) FROM sales) AS by_product, (SELECT CAST(sum(total_revenue) AS DECIMAL(38,2)) FROM revenue) AS by_customer,
            (SELECT CAST(sum(total_revenue) AS DECIMAL(38,2)) FROM days) AS by_day, (SELECT CAST(sum(total_revenue) AS DECIMAL(38,2)) FROM segments) AS by_segment, (SELECT CAST(sum(total_amount) AS DECIMAL(38,2)) FROM q) AS qualifying"""),
        "count_distinct_days": _sql("SELECT (SELECT CAST(count(DISTINCT order_date) AS BIGINT) FROM q) AS qualifying_days, (SELECT CAST(count(*) AS BIGINT) FROM days) AS trend_rows"),
    }
