"""Quarantine rows and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.functions.rules import has_category
from laminar.specs import CATEGORIES, NULL_KEY, Entity


def quarantine_rows(failed: DataFrame, entity: Entity, run_id: str, now: Column | None = None) -> DataFrame:
    """One record per rejected row: its key, the row as JSON (NULL fields left out) and its violations."""
    kept = [c for c in failed.columns if c != "_violations" and not c.startswith("_change")]
    batch = F.col("_batch_id") if "_batch_id" in failed.columns else F.lit(None).cast("string")
    return failed.select(
        F.lit(entity.name).alias("entity_name"),
        F.coalesce(F.col(entity.key).cast("string"), F.lit(NULL_KEY)).alias("primary_key"),
        F.to_json(F.struct(*kept)).alias("data"),
        F.col("_violations").alias("violations"),
        (now if now is not None else F.current_timestamp()).alias("quarantined_at"),
        F.lit(run_id).alias("silver_run_id"),
        batch.alias("bronze_batch_id"),
    )


def quarantine_by_category(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(F.explode("violations").alias("v")).groupBy(F.col("v.category").alias("category")).agg(F.count(F.lit(1)).alias("violations"))


def quality_metrics(annotated: DataFrame, entity: Entity) -> DataFrame:
    """One row per category, all counted in a single pass. rows_quarantined counts the rows that failed the check,
    admitted ones (orphans, the winners among duplicates) included."""
    return metrics_of(annotated.agg(*counts()), entity)


def counts() -> list[Column]:
    """n, and the rows with each category."""
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.when(has_category(c), 1).otherwise(0)), F.lit(0)).alias(c) for c in CATEGORIES]]


def metrics_of(one: DataFrame, entity: Entity) -> DataFrame:
    """The metrics from the one row of their counts."""
    pairs = F.array(*[F.struct(F.lit(c).alias("check_category"), F.col(c).alias("failed")) for c in CATEGORIES])
    rows = one.select("n", F.explode(pairs).alias("x")).select("n", "x.*")
    ok = F.col("n") - F.col("failed")
    return rows.select(
        F.lit(entity.name).alias("entity_name"),
        "check_category",
        F.col("n").alias("rows_evaluated"),
        ok.alias("rows_passed"),
        F.col("failed").alias("rows_quarantined"),
        F.when(F.col("n") > 0, F.round(ok / F.col("n") * 100, 4)).otherwise(0.0).alias("pass_pct"),
    )
