"""Column rules compiled to predicates, and predicates to violations. A NULL predicate passes: only not_null sees NULLs."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.specs import EMAIL, VIOLATION, Rule

VIOLATIONS = T.ArrayType(VIOLATION)

#: (category, rule name, column, predicate)
Predicate = tuple[str, str, str, Column]


def _bound(x: str | int) -> Column:
    """Bounds are decimals, so that no comparison with money goes through a double."""
    return F.lit(Decimal(str(x)))


def _number(rule: Rule, kind: T.DataType) -> Column:
    c = F.col(rule.column)
    if isinstance(kind, T.NumericType):
        return c
    return c.try_cast("bigint" if rule.kind == "integer" else "double")


def _date(rule: Rule, kind: T.DataType) -> Column:
    c = F.col(rule.column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.try_to_date(c.cast("string"), rule.date_format)


def predicates(rule: Rule, kind: T.DataType) -> list[Predicate]:
    """The predicates of one rule on a column of the given type; True passes."""
    c, made = F.col(rule.column), []
    if not rule.nullable:
        made.append(("completeness", "not_null", c.isNotNull()))
    tests: dict[str, Column | None] = {}
    if rule.kind == "string":
        tests = {
            "min_length": F.length(c) >= rule.min_length if rule.min_length is not None else None,
            "max_length": F.length(c) <= rule.max_length if rule.max_length is not None else None,
            "pattern": c.rlike(rule.pattern) if rule.pattern else None,
            "format_email": c.rlike(EMAIL) if rule.format == "email" else None,
            "enum": c.isin(*rule.enum) if rule.enum else None,
        }
    elif rule.kind in ("integer", "number"):
        n = _number(rule, kind)
        for name, test in (
            ("minimum", lambda b: n >= b), ("maximum", lambda b: n <= b),
            ("exclusive_minimum", lambda b: n > b), ("exclusive_maximum", lambda b: n < b),
            ("multiple_of", lambda b: n % b == 0),
        ):
            x = getattr(rule, name)
            tests[name] = test(_bound(x)) if x is not None else None
    else:
        d = _date(rule, kind)
        last = F.current_date() if rule.max_date == "today" else F.lit(rule.max_date).cast("date")
        tests = {
            "min_date": d >= F.lit(rule.min_date).cast("date") if rule.min_date else None,
            "max_date": d <= last if rule.max_date else None,
        }
    made += [("type_logic", name, test) for name, test in tests.items() if test is not None]
    return [(category, name, rule.column, test) for category, name, test in made]


def violation(category: str, rule: str, column: str, broken: Column) -> Column:
    """The violation's struct where broken is true, else NULL."""
    fields = F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(column).cast("string").alias("value"))
    return F.when(broken, fields)


def annotate(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """df with _violations; rules on columns that df lacks are skipped."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [violation(category, name, column, ~test) for rule in rules if rule.column in kinds for category, name, column, test in predicates(rule, kinds[rule.column])]
    return df.withColumn("_violations", listed(found, F.array().cast(VIOLATIONS)))


def listed(found: list[Column], before: Column) -> Column:
    """The list before and the violations found. Most rows have none: they get the list as it is, for making another is interpreted row by row."""
    if not found:
        return before
    more = F.concat(before, F.array_compact(F.array(*found))).cast(VIOLATIONS)
    return F.when(reduce(or_, (v.isNotNull() for v in found)), more).otherwise(before)


def has_category(*categories: str) -> Column:
    return (F.size("_violations") > 0) & F.exists("_violations", lambda v: v["category"].isin(*categories))
