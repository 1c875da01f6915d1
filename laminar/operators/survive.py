"""Which row of a key survives, and which rows are rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminar.functions.rules import has_category
from laminar.specs import ADMITTING, BRONZE_COLUMNS, Entity


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as text, joined by ||; NULL and empty text hash alike."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def blocking() -> Column:
    """The violations that reject a row."""
    return F.filter("_violations", lambda v: ~v["category"].isin(*ADMITTING))


def orphan() -> Column:
    return has_category("referential")


def _order(entity: Entity, there: list[str]) -> list[Column]:
    """Later deliveries first, by when they came, for batch ids may be random; then event date, arrival and hash."""
    keys = ["_delivered_at", "_batch_id", entity.event_time, "_ingest_timestamp", "_row_hash"]
    return [F.col(k).desc_nulls_last() for k in keys if k and k in there]


def arrivals(df: DataFrame) -> DataFrame:
    """When each delivery came: one row for each."""
    return df.groupBy("_batch_id").agg(F.max("_ingest_timestamp").alias("_delivered_at"))


def delivered(df: DataFrame, came: DataFrame) -> DataFrame:
    """df with _delivered_at. Arrivals are sent to every executor: met otherwise, all rows would be dealt by their delivery."""
    return df.join(F.broadcast(came.withColumnRenamed("_batch_id", "_b")), F.col("_batch_id").eqNullSafe(F.col("_b")), "left").drop("_b")


def ranked(df: DataFrame, entity: Entity) -> DataFrame:
    """df with _row_hash, _pk_rank (over all deliveries) and _delivery_rank (within one)."""
    shown, deliveries = [c for c in df.columns if c != "_row_hash"], "_batch_id" in df.columns
    if "_ingest_timestamp" in df.columns and deliveries and "_delivered_at" not in df.columns:
        df = delivered(df, arrivals(df))
    # dealt by the key before they are hashed: a hash is longer than all else that a row needs
    rows = df.repartition(F.col(entity.key)).withColumn("_row_hash", row_hash(entity.columns))
    order, within = _order(entity, rows.columns), Window.partitionBy(entity.key)
    rows = rows.withColumn("_pk_rank", F.row_number().over(within.orderBy(*order)))
    # the order begins with the delivery, so a delivery's rows are a run, and exact copies stand alike in both ranks
    before = F.rank().over(within.orderBy(*order[: 1 + ("_delivered_at" in rows.columns)])) - 1 if deliveries else F.lit(0)
    rows = rows.withColumn("_delivery_rank", F.col("_pk_rank") - before)
    return rows.select(*shown, "_row_hash", *(["_delivered_at"] if "_delivered_at" in rows.columns and "_delivered_at" not in shown else []), "_delivery_rank", "_pk_rank")


@dataclass(frozen=True)
class Split:
    survivors: DataFrame
    passed: DataFrame
    failed: DataFrame
    superseded: DataFrame


def judged(annotated: DataFrame, entity: Entity) -> DataFrame:
    """Rows with their ranks and _bad: whether a violation rejects them."""
    return ranked(annotated, entity).withColumn("_bad", (F.size("_violations") > 0) & (F.size(blocking()) > 0))


def rejected() -> Column:
    return F.col("_bad") | (F.col("_delivery_rank") > 1)


def parted(rows: DataFrame) -> Split:
    """Judged rows by fate. A defective newest row shadows an older good one, which is then superseded; a row that a later
    delivery replaces without having a defect is neither passed nor failed."""
    first = F.col("_pk_rank") == 1
    return Split(rows.filter(first), rows.filter(first & ~rejected()), rows.filter(rejected()), rows.filter(~first & ~rejected()))


def split(annotated: DataFrame, entity: Entity) -> Split:
    return parted(judged(annotated, entity))


def prepared(passed: DataFrame, entity: Entity, now: Column | None = None) -> DataFrame:
    """Passed rows in the shape of a conformed table."""
    batch = F.col("_batch_id") if "_batch_id" in passed.columns else F.lit(None).cast("string")
    lost = orphan() if "_violations" in passed.columns else F.lit(False)
    return passed.select(
        *entity.columns,
        F.lit("PASS").alias("quality_check_result"),
        row_hash(entity.columns).alias("_row_hash"),
        F.lit(False).alias("_is_deleted"),
        F.coalesce(lost, F.lit(False)).alias("_is_orphan"),
        (now if now is not None else F.current_timestamp()).alias("_silver_updated_at"),
        batch.alias("_bronze_batch_id"),
    )


def ingested(df: DataFrame, entity: Entity, batch_id: str, at: Column, source: Column | None = None) -> DataFrame:
    """df with the columns that ingest adds; customers also get their row hash."""
    out = df.withColumns({
        "_ingest_timestamp": at,
        "_source_file": source if source is not None else F.lit(None).cast("string"),
        "_batch_id": F.lit(batch_id),
        "_delivery_pattern": F.lit(entity.delivery),
    })
    if "_rescued_data" not in out.columns:
        out = out.withColumn("_rescued_data", F.lit(None).cast("string"))
    if entity.name == "customers":
        out = out.withColumn("_row_hash", row_hash(entity.columns))
    return out


def business(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BRONZE_COLUMNS and not c.startswith("_")]
