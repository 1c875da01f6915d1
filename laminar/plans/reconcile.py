"""Queries that prove that the layers agree. They return counts, so that an empty difference is visible as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.operators.state import with_orphans
from laminar.specs import Entity


def full_outer_diff(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of keys on one side alone and of keys whose values differ, NULLs being equal."""
    a = left.select(F.col(key).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in values])
    b = right.select(F.col(key).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return a.join(b, F.col("_l") == F.col("_r"), "full_outer").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(both & ~same).alias("different"),
    )


def unaccounted_keys(delivered: DataFrame, conformed: DataFrame, quarantine: DataFrame, entity: Entity) -> DataFrame:
    """The number of delivered keys that are neither conformed nor quarantined."""
    keys = delivered.select(entity.key).filter(F.col(entity.key).isNotNull()).distinct()
    held = quarantine.filter(F.col("entity_name") == entity.name).select(F.col("primary_key").alias("_q"))
    left = keys.join(conformed.select(entity.key), entity.key, "left_anti").join(held, F.col(entity.key).cast("string") == F.col("_q"), "left_anti")
    return left.agg(F.count(F.lit(1)).alias("unaccounted"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))


def orphans_wrongly(child: DataFrame, parents: dict[str, DataFrame], entity: Entity, flag: bool) -> DataFrame:
    """The number of rows that carry the flag (or don't) while their parents say otherwise."""
    rows = with_orphans(child, parents, entity)
    return rows.filter((F.col("_is_orphan") == flag) & (F.col("_now") != flag)).agg(F.count(F.lit(1)).alias("wrong"))


def cross_foot(sales: DataFrame, revenue: DataFrame, days: DataFrame, segmentation: DataFrame, qualifying: DataFrame) -> DataFrame:
    """The same revenue by five roads, in one row."""
    total = lambda df, c, name: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)").alias(name))
    parts = [total(sales, "total_revenue", "by_product"), total(revenue, "total_revenue", "by_customer"), total(days, "total_revenue", "by_day"), total(segmentation, "total_revenue", "by_segment"), total(qualifying, "total_amount", "qualifying")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def distinct_days(qualifying: DataFrame, days: DataFrame) -> DataFrame:
    a = qualifying.agg(F.countDistinct("order_date").alias("qualifying_days"))
    return a.crossJoin(F.broadcast(days.agg(F.count(F.lit(1)).alias("trend_rows"))))
