"""Checks on sets of rows; each adds to _violations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.functions.rules import listed, violation
from laminar.specs import Check


#: Words of 64 keys that are sent to every executor at most (some tens of MB).
WORDS = 1 << 19


def append_violation(df: DataFrame, *found: Column) -> DataFrame:
    """df with violations (or NULLs) added to its list."""
    return df.withColumn("_violations", listed(list(found), F.col("_violations")))


def _is_null(column: str) -> Column:
    return violation("completeness", "not_null", column, F.col(column).isNull())


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return append_violation(df, _is_null(column))


def with_many(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """df with whether a row's key stands more than once in its delivery; NULL keys are one key.

    A delivery's rows are the peers within a key: dealt by the key alone, the rows stay in place for what ranks them next."""
    scope = Window.partitionBy(*columns)
    if "_batch_id" in df.columns:
        scope = scope.orderBy("_batch_id").rangeBetween(Window.currentRow, Window.currentRow)
    return df.withColumn(name, F.count(F.lit(1)).over(scope) > 1)


def _not_unique(columns: tuple[str, ...], many: str) -> Column:
    return violation("uniqueness", "uniqueness", columns[0], F.col(many))


def check_uniqueness(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Flags every row of a key that stands more than once in one delivery."""
    return append_violation(with_many(df, columns, "_many"), _not_unique(columns, "_many")).drop("_many")


def live_rows(parent: DataFrame, key: str, alias: str) -> DataFrame:
    """The keys of a parent's rows that aren't deleted."""
    live = parent.filter(~F.col("_is_deleted")) if "_is_deleted" in parent.columns else parent
    return live.select(F.col(key).alias(alias)).filter(F.col(alias).isNotNull())


def live_keys(parent: DataFrame, key: str, alias: str) -> DataFrame:
    """The distinct keys of a parent's rows that aren't deleted."""
    return live_rows(parent, key, alias).distinct()


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def with_lost(df: DataFrame, column: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """df with whether its key isn't NULL and has no live parent.

    Whole-number keys are met as words of 64 neighbours, a bit for each live key: while there are WORDS of them at most they are sent to every
    executor, and df isn't dealt anew. Other keys, and more words, are met by a join of the rows with the distinct keys."""
    if _whole(df, column) and _whole(parent, parent_key):
        live = live_rows(parent, parent_key, "_parent").groupBy(F.shiftright(F.col("_parent").cast("long"), 6).alias("_word"))
        words = live.agg(F.bit_or(F.expr("shiftleft(1L, CAST(_parent & 63 AS INT))")).alias("_bits"))
        if words.limit(WORDS + 1).count() <= WORDS:
            own = F.col(column).cast("long")
            held = F.coalesce(F.getbit("_bits", own.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
            met = df.join(F.broadcast(words), F.shiftright(own, 6) == F.col("_word"), "left")
            return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(column).isNotNull() & ~held).alias(name))
    met = df.join(live_keys(parent, parent_key, "_parent"), F.col(column) == F.col("_parent"), "left")
    return met.withColumn(name, F.col(column).isNotNull() & F.col("_parent").isNull()).drop("_parent")


def _no_parent(column: str, lost: str) -> Column:
    return violation("referential", "fk_exists", column, F.col(lost))


def check_fk_exists(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Flags rows whose key isn't NULL and has no live parent."""
    return append_violation(with_lost(df, column, parent, parent_key, "_lost"), _no_parent(column, "_lost")).drop("_lost")


def apply_checks(df: DataFrame, checks: Iterable[Check], parent: Callable[[str], DataFrame]) -> DataFrame:
    """All checks, their violations in their order; parent gives a parent entity's table. Parents are met before the rows of a key come together, so
    that those are still in place for the ranks."""
    checks, shown = list(checks), df.columns
    for k, check in enumerate(checks):
        if check.kind == "fk_exists":
            df = with_lost(df, check.columns[0], parent(check.parent), check.parent_key, f"_flag_{k}")
    for k, check in enumerate(checks):
        if check.kind == "uniqueness":
            df = with_many(df, check.columns, f"_flag_{k}")
    found: list[Column] = []
    for k, check in enumerate(checks):
        if check.kind == "not_null":
            found += [_is_null(c) for c in check.columns]
        else:
            found.append(_not_unique(check.columns, f"_flag_{k}") if check.kind == "uniqueness" else _no_parent(check.columns[0], f"_flag_{k}"))
    return append_violation(df, *found).select(*[F.col(f"`{c}`") for c in shown]) if found else df
