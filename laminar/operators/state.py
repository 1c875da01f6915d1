"""Changes of a conformed table as pure functions: each takes the table and gives the next one, or what would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.operators.checks import with_lost
from laminar.specs import SILVER_COLUMNS, Entity


def _met(target: DataFrame, source: DataFrame, entity: Entity) -> DataFrame:
    """Both sides' columns, as t_ and s_, and whether there is such a row. The key is joined as it is: rows that lie by it aren't dealt anew."""
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("t"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("s"))
    return t.join(s, F.col(f"t_{entity.key}") == F.col(f"s_{entity.key}"), "full_outer")


def _action() -> Column:
    changed = (
        F.col("t__row_hash").isNull()
        | (F.col("t__row_hash") != F.col("s__row_hash"))
        | F.coalesce(F.col("t__is_deleted"), F.lit(False))
        | ~F.col("t__is_orphan").eqNullSafe(F.col("s__is_orphan"))
    )
    return F.when(F.col("t").isNull(), "insert").when(F.col("s").isNull(), "keep").when(changed, "update").otherwise("keep")


def upsert_actions(target: DataFrame, source: DataFrame, entity: Entity) -> DataFrame:
    """(key, action): insert new keys, update those whose hash, deletion or orphan flag differs, keep the rest. Only those columns are read."""
    told = [entity.key, "_row_hash", "_is_deleted", "_is_orphan"]
    return _met(target.select(*told), source.select(*told), entity).select(F.coalesce(f"t_{entity.key}", f"s_{entity.key}").alias(entity.key), _action().alias("action"))


def upsert(target: DataFrame, source: DataFrame, entity: Entity) -> DataFrame:
    """The table after the upsert, with _action for the counts. An update revives a deleted row."""
    rows = _met(target, source, entity).withColumn("_action", _action())
    pick = [F.when(F.col("_action") == "keep", F.col(f"t_{c}")).otherwise(F.col(f"s_{c}")).alias(c) for c in target.columns]
    return rows.select(*pick, "_action")


def missing_keys(target: DataFrame, snapshot: DataFrame, entity: Entity) -> DataFrame:
    """The keys of live rows that a snapshot leaves out."""
    if entity.delivery != "full_snapshot":
        return target.select(entity.key).limit(0)
    live = target.filter(~F.coalesce("_is_deleted", F.lit(False))).select(entity.key)
    return live.join(snapshot.select(entity.key).distinct(), entity.key, "left_anti")


def soft_delete(target: DataFrame, snapshot: DataFrame, entity: Entity, now: Column | None = None) -> DataFrame:
    """The table with rows that the snapshot leaves out marked as deleted; none is ever revived here."""
    gone = missing_keys(target, snapshot, entity).distinct().withColumn("_gone", F.lit(True))
    rows = target.join(gone, entity.key, "left")
    marked = {"_is_deleted": F.coalesce("_gone", "_is_deleted")}
    if "_silver_updated_at" in target.columns:
        marked["_silver_updated_at"] = F.when(F.col("_gone"), now if now is not None else F.current_timestamp()).otherwise(F.col("_silver_updated_at"))
    return rows.withColumns(marked).select(*target.columns)


def with_orphans(child: DataFrame, parents: dict[str, DataFrame], entity: Entity) -> DataFrame:
    """child with _now: whether any foreign key has no live parent today."""
    lost, rows = F.lit(False), child
    for column, (name, key) in entity.foreign_keys.items():
        rows = with_lost(rows, column, parents[name], key, f"_lost_{column}")
        lost = lost | F.col(f"_lost_{column}")
    return rows.select(*child.columns, lost.alias("_now"))


def refresh_orphans(child: DataFrame, parents: dict[str, DataFrame], entity: Entity) -> DataFrame:
    """The child table with its orphan flags set and cleared; nothing else of a row changes."""
    rows = with_orphans(child, parents, entity)
    return rows.withColumn("_is_orphan", F.col("_now")).select(*child.columns)


def orphan_changes(child: DataFrame, parents: dict[str, DataFrame], entity: Entity) -> DataFrame:
    """(key, was, now) of the rows whose flag differs."""
    rows = with_orphans(child.select(entity.key, *entity.foreign_keys, "_is_orphan"), parents, entity)
    return rows.filter(~F.col("_is_orphan").eqNullSafe(F.col("_now"))).select(entity.key, F.col("_is_orphan").alias("was_orphan"), F.col("_now").alias("is_orphan"))


def conformed_columns(entity: Entity) -> list[str]:
    return [*entity.columns, *SILVER_COLUMNS]
