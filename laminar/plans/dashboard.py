"""Dashboard datasets and widgets over gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measures(revenue: DataFrame) -> DataFrame:
    return revenue.agg(F.sum("total_revenue").alias("revenue"), F.sum("total_orders").alias("orders"), F.sum(F.when(F.col("total_orders") > 0, 1).otherwise(0)).alias("active_customers"))


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """The n products of most revenue; product_id breaks ties."""
    return sales.orderBy(F.desc("total_revenue"), "product_id").limit(n)


def top_products_bar(sales: DataFrame, category: str | None = None) -> DataFrame:
    """The top products by name and category; a category filters within the ten."""
    rows = top_products(sales)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("product_name", "category").agg(F.sum("total_revenue").alias("total_revenue"))


def trends(days: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    if first:
        days = days.filter(F.col("order_date") >= F.lit(first).cast("date"))
    if last:
        days = days.filter(F.col("order_date") <= F.lit(last).cast("date"))
    return days.orderBy("order_date")


def weekly(days: DataFrame, measure: str) -> DataFrame:
    return days.groupBy(F.date_trunc("week", "order_date").cast("date").alias("week")).agg(F.sum(measure).alias(measure)).orderBy(F.desc("week"))


def active_customers(revenue: DataFrame, segment: str | None = None) -> DataFrame:
    if segment is not None:
        revenue = revenue.filter(F.col("customer_segment") == segment)
    return revenue.agg(F.coalesce(F.sum(F.when(F.col("total_orders") > 0, 1).otherwise(0)), F.lit(0)).alias("active_customers"))


def segments(segmentation: DataFrame) -> DataFrame:
    return segmentation.groupBy("segment_type").agg(F.sum("customer_count").alias("customers"))


def revenue_histogram(revenue: DataFrame, width: int = 1000) -> DataFrame:
    """Customers by bin of revenue, the bin of no revenue included."""
    low = (F.floor(F.col("total_revenue") / width) * width).cast("long")
    return revenue.groupBy(low.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
