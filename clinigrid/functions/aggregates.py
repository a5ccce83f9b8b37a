"""Aggregates that treat missing values the way the analyses expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unless_missing(col: Column | str, value: Column) -> Column:
    column = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(column) == F.count(F.lit(1)), value)


def sum_strict(col: Column | str) -> Column:
    """Sum that is missing as soon as one value of the group is missing."""
    return _unless_missing(col, F.sum(col))


def mean_strict(col: Column | str) -> Column:
    return _unless_missing(col, F.avg(col))


def max_strict(col: Column | str) -> Column:
    return _unless_missing(col, F.max(col))


def sum_or_zero(col: Column | str) -> Column:
    """Sum that skips missing values; a group without values gives 0."""
    return F.coalesce(F.sum(col), F.lit(0))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
