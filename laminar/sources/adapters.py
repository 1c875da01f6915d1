"""The three entities as relations over star-schema tables, with planted defects; one SQL text per entity.

Names of tables are passed through `table`, so that the same text reads Parquet folders or registered views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixture parameters that suit these tables: first day accepted, segment constants.
FIRST_DAY, INACTIVE_DAYS, HIGH_VALUE = "1994-01-01", 365, "500000"

_CUSTOMERS = """
SELECT CAST(c_custkey AS INT) AS customer_id,
 CASE WHEN c_custkey % 83 = 1 THEN 'A' WHEN c_custkey % 83 = 2 THEN repeat('X', 120) ELSE c_name END AS customer_name,
 CASE WHEN c_custkey % 97 = 3 THEN NULL WHEN c_custkey % 97 = 4 THEN 'not-an-email' ELSE concat('c', CAST(c_custkey AS STRING), '@example.com') END AS email,
 CASE WHEN c_custkey % 101 = 5 THEN 'X1!' ELSE r_name END AS country,
 CASE WHEN c_custkey % 103 = 6 THEN DATE '2100-01-01' ELSE DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) END AS signup_date,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Premium' WHEN 'BUILDING' THEN 'Premium' WHEN 'FURNITURE' THEN 'Standard' WHEN 'HOUSEHOLD' THEN 'Standard' ELSE CASE WHEN c_custkey % 50 = 7 THEN 'Invalid' ELSE 'Basic' END END AS customer_segment,
 CAST(c_acctbal AS DECIMAL(18,2)) AS lifetime_value
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

_PRODUCTS = """
SELECT CAST(p_partkey AS INT) AS product_id, CASE WHEN p_partkey % 211 = 1 THEN repeat('P', 220) ELSE p_name END AS product_name, p_type AS category,
 CASE WHEN p_partkey % 199 = 2 THEN CAST(-1 AS DECIMAL(18,2)) ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS price,
 CASE WHEN p_partkey % 197 = 3 THEN CAST(-2 AS DECIMAL(18,2)) ELSE CAST(p_size AS DECIMAL(18,2)) END AS cost,
 CASE WHEN p_partkey % 193 = 4 THEN -5 WHEN p_partkey % 193 = 5 THEN 101000 ELSE p_size * 10 END AS stock_quantity, p_size AS reorder_level FROM {part}
"""

_ORDERS = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS order_id,
 CASE WHEN l_orderkey % 307 = 1 THEN NULL WHEN l_orderkey % 307 = 2 THEN 900001 ELSE CAST(o_custkey AS INT) END AS customer_id,
 CASE WHEN l_orderkey % 311 = 3 THEN DATE '1990-06-15' WHEN l_orderkey % 311 = 4 THEN DATE '2100-01-01' ELSE CAST(o_orderdate AS DATE) END AS order_date,
 CASE WHEN l_partkey % 313 = 5 THEN NULL WHEN l_partkey % 313 = 6 THEN 910001 ELSE CAST(l_partkey AS INT) END AS product_id,
 CASE WHEN l_orderkey % 317 = 7 THEN 0 WHEN l_orderkey % 317 = 8 THEN 1500 ELSE CAST(l_quantity AS INT) END AS quantity,
 CASE WHEN l_orderkey % 331 = 9 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS unit_price,
 CASE WHEN l_orderkey % 337 = 10 THEN CAST(-10 AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS total_amount,
 CASE WHEN l_orderkey % 347 = 11 THEN 'Invalid' WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'Pending' ELSE 'Cancelled' END AS order_status,
 CASE WHEN o_orderstatus = 'F' THEN CAST(l_shipdate AS DATE) END AS payment_date,
 concat('b', CAST(l_suppkey % 2 + 1 AS STRING)) AS _batch_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

#: A few rows of a snapshot come twice in one delivery, and a few come without their key.
_SNAPSHOT = """
WITH base AS ({base})
SELECT *, 'b1' AS _batch_id, TIMESTAMP '2024-01-01 00:00:00' AS _ingest_timestamp FROM base
UNION ALL SELECT *, 'b1', TIMESTAMP '2024-01-01 00:00:00' FROM base WHERE {key} % 89 = 10
UNION ALL SELECT CAST(NULL AS INT), {rest}, 'b1', TIMESTAMP '2024-01-01 00:00:00' FROM base WHERE {key} % 457 = 11
"""

_DELIVERIES = """
WITH base AS ({base})
SELECT *, CASE WHEN _batch_id = 'b1' THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS _ingest_timestamp FROM base
UNION ALL SELECT CAST(NULL AS INT), customer_id, order_date, product_id, quantity, unit_price, total_amount, order_status, payment_date, _batch_id,
 TIMESTAMP '2024-01-01 00:00:00' FROM base WHERE _batch_id = 'b1' AND order_id % 4003 = 12
"""

TABLES = ("customer", "nation", "region", "part", "lineitem", "orders")


def entity_sql(name: str, table: Callable[[str], str]) -> str:
    """The relation of an entity as delivered: business columns, _batch_id and _ingest_timestamp."""
    fill = {t: table(t) for t in TABLES}
    if name == "customers":
        rest = "customer_name, email, country, signup_date, customer_segment, lifetime_value"
        return _SNAPSHOT.format(base=_CUSTOMERS.format(**fill), key="customer_id", rest=rest)
    if name == "products":
        return _SNAPSHOT.format(base=_PRODUCTS.format(**fill), key="product_id", rest="product_name, category, price, cost, stock_quantity, reorder_level")
    return _DELIVERIES.format(base=_ORDERS.format(**fill))


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(entity_sql(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def dated(orders: DataFrame) -> DataFrame:
    """orders with _delivered_at. A delivery of them comes at one instant, so that each row's arrival is its delivery's."""
    return orders.withColumn("_delivered_at", F.col("_ingest_timestamp"))


def order_slices(spark: SparkSession, sf_dir: str, n: int) -> Iterator[DataFrame]:
    """All orders in n runs of the keys of their lines. Each line lies in one run, so that a key's rows do; those that come without their key lie in the
    run of the line they are made from, and any run may have some. Each run reads the lines and orders it needs."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = lines.agg(F.min("l_linenumber"), F.max("l_linenumber"), F.count_if(F.col("l_linenumber").isNull())).first() if n > 1 else (None, None, 0)
    low, high, bare = found
    if low is None:
        yield entity(spark, sf_dir, "orders")
        return
    key = "(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber)"
    edges = sorted({int(k) for k in lines.selectExpr(f"{key} AS k").approxQuantile("k", [i / n for i in range(1, n)], 1 / (10 * n))})

    def rows(own: list[str], near: list[str]) -> DataFrame:
        tests = {"lineitem": own + [f"l_orderkey {x}" for x in near], "orders": [f"o_orderkey {x}" for x in near]}

        def table(t: str) -> str:
            file = f"parquet.`{sf_dir}/{t}.parquet`"
            return f"(SELECT * FROM {file} WHERE {' AND '.join(tests[t])})" if tests.get(t) else file

        return spark.sql(entity_sql("orders", table))

    for a, b in pairwise([None, *edges, None]):
        # line numbers bound the order keys that the run's keys come from
        near = ([f">= {(a - high) // 10}"] if a is not None else []) + ([f"<= {(b - 1 - low) // 10}"] if b is not None else [])
        yield rows(([f"{key} >= {a}"] if a is not None else []) + ([f"{key} < {b}"] if b is not None else []) or [f"{key} IS NOT NULL"], near)
    if bare:
        yield rows(["l_linenumber IS NULL"], [])
