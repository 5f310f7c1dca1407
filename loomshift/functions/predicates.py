"""Predicates in three-valued logic, where a plain Column operator needs care."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(text: Column, pattern: str, negate: bool = False, ignore_case: bool = False) -> Column:
    """LIKE without an escape character: % and _ are wild, a backslash is itself."""
    pattern = pattern.replace("\\", "\\\\")
    found = F.ilike(text, F.lit(pattern)) if ignore_case else F.like(text, F.lit(pattern))
    return ~found if negate else found


def in_list(value: Column, items: list, negate: bool = False) -> Column:
    """IN: null where no item matches and the value or an item is null."""
    found = value.isin([x for x in items if x is not None])
    if None in items:
        found = F.when(found, True).otherwise(F.lit(None).cast("boolean"))
    return ~found if negate else found


def between(value: Column, low: Column, high: Column, negate: bool = False, symmetric: bool = False) -> Column:
    """BETWEEN with both ends; SYMMETRIC swaps them where needed."""
    found = value.between(F.least(low, high), F.greatest(low, high)) if symmetric else value.between(low, high)
    return ~found if negate else found


def is_true(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def is_false(value: Column) -> Column:
    return F.coalesce(~value, F.lit(False))


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
