"""The manifest of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """The last run of each layer and entity, by start and then by run id."""
    last = Window.partitionBy("layer", "entity_name").orderBy(F.desc("started_at"), F.desc("run_id"))
    return manifest.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def most_rows(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n batches or files that brought most rows; the name breaks ties. Counted per task before the shuffle, so a batch of any size is cheap."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def since(rows: DataFrame, column: str, start_ms: int, slack_ms: int = 60_000) -> DataFrame:
    """Rows whose time is at or after start_ms (milliseconds since 1970, UTC), less a slack for clocks that differ. The bound is a constant, so it reaches the scan."""
    return rows.filter(F.col(column) >= F.timestamp_millis(F.lit(start_ms - slack_ms)))
