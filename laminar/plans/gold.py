"""Gold aggregates as functions of DataFrames; no table is named inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days without an order that make a customer inactive, and revenue of a high-value one.
INACTIVE_DAYS, HIGH_VALUE = 90, "5000"


def is_qualifying() -> Column:
    """The one definition of an order that counts; a NULL status doesn't."""
    return (F.col("order_status") == "Completed") & ~F.col("_is_orphan") & ~F.col("_is_deleted")


def qualifying_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(is_qualifying()).select("order_id", "customer_id", "product_id", "order_date", "total_amount")


def input_breakdown(orders: DataFrame) -> DataFrame:
    """Counts of one pass; the categories overlap."""
    parts = {
        "rows_qualifying": is_qualifying(),
        "rows_pending": F.col("order_status") == "Pending",
        "rows_cancelled": F.col("order_status") == "Cancelled",
        "rows_orphan": F.col("_is_orphan"),
        "rows_deleted": F.col("_is_deleted"),
    }
    return orders.agg(F.count(F.lit(1)).alias("rows_total"), *[F.count_if(p).alias(n) for n, p in parts.items()])


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def _totals(amount: str = "total_amount") -> list[Column]:
    n = F.count("order_id")
    total = F.sum(amount)
    return [
        n.alias("total_orders"),
        _money(F.coalesce(total, F.lit(0))).alias("total_revenue"),
        _money(total / F.nullif(n, F.lit(0))).alias("avg_order_value"),
    ]


def _by_dimension(dimension: DataFrame, qualifying: DataFrame, key: str, shown: list[str], *more: Column) -> DataFrame:
    """Live rows of a dimension with the totals of their orders, those without any included.

    Orders are summed per key before the join: one row per key meets the dimension, so a hot key can't skew it."""
    live = dimension.filter(~F.col("_is_deleted")).select(key, *shown)
    sums = qualifying.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("order_id").alias("_n"), F.sum("total_amount").alias("_sum"), *more)
    return live.join(sums, key, "left")


def _shown_totals() -> list[Column]:
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return [
        n.alias("total_orders"),
        _money(F.coalesce("_sum", F.lit(0))).alias("total_revenue"),
        _money(F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias("avg_order_value"),
    ]


def sales_by_product(products: DataFrame, qualifying: DataFrame) -> DataFrame:
    shown = ["product_name", "category"]
    return _by_dimension(products, qualifying, "product_id", shown).select("product_id", *shown, *_shown_totals())


def revenue_by_customer(customers: DataFrame, qualifying: DataFrame) -> DataFrame:
    shown = ["customer_name", "customer_segment"]
    rows = _by_dimension(customers, qualifying, "customer_id", shown, F.max("order_date").alias("last_order_date"))
    return rows.select("customer_id", *shown, *_shown_totals(), _money(F.coalesce("_sum", F.lit(0))).alias("lifetime_value_actual"), "last_order_date")


def daily_weekly_trends(qualifying: DataFrame) -> DataFrame:
    """A row per day that has orders, with the Monday of its week."""
    days = qualifying.groupBy("order_date").agg(*_totals())
    return days.select("order_date", F.date_trunc("week", "order_date").cast("date").alias("week_start"), "total_orders", "total_revenue", "avg_order_value")


def segment_labels(revenue: DataFrame, inactive_days: int = INACTIVE_DAYS, high_value: str = HIGH_VALUE) -> DataFrame:
    """Customers with segment_type; recency outranks value, and exactly inactive_days ago is still active."""
    as_of = revenue.agg(F.max("last_order_date").alias("_as_of"))  # one row
    last = F.col("last_order_date")
    kind = (
        F.when(last.isNull() | (last < F.date_sub("_as_of", inactive_days)), "Inactive")
        .when(F.col("lifetime_value_actual") >= F.lit(high_value).cast("decimal(18,2)"), "High-Value")
        .when(F.col("total_orders") >= 2, "Repeat")
        .otherwise("One-Time")
    )
    return revenue.crossJoin(F.broadcast(as_of)).withColumn("segment_type", kind).drop("_as_of")


def customer_segmentation(revenue: DataFrame, inactive_days: int = INACTIVE_DAYS, high_value: str = HIGH_VALUE) -> DataFrame:
    total, n = F.sum("total_revenue"), F.count(F.lit(1))
    labelled = segment_labels(revenue, inactive_days, high_value)
    return labelled.groupBy("segment_type").agg(n.alias("customer_count"), _money(total / n).alias("avg_revenue"), _money(total).alias("total_revenue"))
