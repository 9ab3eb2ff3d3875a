"""Predicates and arithmetic of checks, two-valued: a comparison with null is false, its negation true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as tx

NUMBER = "decimal(38,10)"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def typed(c: Column) -> tuple[Column, Column]:
    """A text cell as (number, text): blank is null in both, a number is null as text."""
    v = tx.filled(c)
    number = F.when(tx.trim_ws(v).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), tx.trim_ws(v).try_cast(NUMBER))
    return number, F.when(number.isNull(), v)


def ref(df: DataFrame, name: str) -> Column:
    """A column by ``table.column`` or ``column``: exact, else regardless of case."""
    column = name.partition(".")[2] or name
    if column in df.columns:
        return df[column]
    return df[next((c for c in df.columns if c.lower() == column.lower()), column)]


def add(a: Column, b: Column) -> Column:
    return _zero(a) + _zero(b)


def sub(a: Column, b: Column) -> Column:
    return _zero(a) - _zero(b)


def mul(a: Column, b: Column) -> Column:
    return _zero(a) * _zero(b)


def div(a: Column, b: Column, excluding: bool = False) -> Column:
    """Division; by zero it is an error, or null (no match) when ``excluding`` rows in a filter."""
    return F.try_divide(_zero(a), _zero(b)) if excluding else _zero(a) / _zero(b)


def neg(c: Column) -> Column:
    return -_zero(c)


def eq(a: Column, b: Column) -> Column:
    return _false(a == b)


def ne(a: Column, b: Column) -> Column:
    return ~_false(a == b)


def gt(a: Column, b: Column) -> Column:
    return _false(a > b)


def ge(a: Column, b: Column) -> Column:
    return _false(a >= b)


def lt(a: Column, b: Column) -> Column:
    return _false(a < b)


def le(a: Column, b: Column) -> Column:
    return _false(a <= b)


def and_(a: Column, b: Column) -> Column:
    return _false(a) & _false(b)


def or_(a: Column, b: Column) -> Column:
    return _false(a) | _false(b)


def not_(c: Column) -> Column:
    return ~_false(c)


def in_list(c: Column, values: list, negated: bool = False) -> Column:
    found = _false(c.isin(*values)) if values else F.lit(False)
    return ~found if negated else found


def between(c: Column, low: Column, high: Column, negated: bool = False) -> Column:
    found = _false((c >= low) & (c <= high))
    return ~found if negated else found


def is_null(c: Column) -> Column:
    return c.isNull()


def is_not_null(c: Column) -> Column:
    return c.isNotNull()


def like(c: Column, pattern: str, negated: bool = False) -> Column:
    """``%`` and ``_``; regardless of case, no escape character, null as empty."""
    found = tx.text(c).ilike(pattern.replace("\\", "\\\\"))
    return ~found if negated else found


def case_when(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = None
    for condition, value in branches:
        out = F.when(_false(condition), value) if out is None else out.when(_false(condition), value)
    return out.otherwise(otherwise) if otherwise is not None else out


def iif(condition: Column, a: Column, b: Column) -> Column:
    return F.when(_false(condition), a).otherwise(b)


def coalesce_(*columns: Column) -> Column:
    return F.coalesce(*columns)


def nullif_(a: Column, b: Column) -> Column:
    return F.when(ne(a, b), a)


def literal(value) -> Column:
    return F.lit(value)
