"""Choosing, renaming and rewriting groups of columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def front(df: DataFrame, *names: str) -> DataFrame:
    """``names`` first, every other column after them."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def columns_matching(
    df: DataFrame, prefix: str | None = None, contains: str | None = None
) -> list[str]:
    """Column names by prefix and / or substring; case does not matter."""
    return [
        c for c in df.columns
        if (prefix is None or c.lower().startswith(prefix.lower()))
        and (contains is None or contains.lower() in c.lower())
    ]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def apply_across(
    df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]
) -> DataFrame:
    """The same column function over many columns, as one projection."""
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in names})


def drop_all_missing(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value in any row (one aggregate pass, one row back)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    found = counts.first()
    return df.drop(*[c for i, c in enumerate(df.columns) if found[i] == 0])


def literal(value: object) -> str:
    """A Python value as SQL text, for expressions generated in bulk."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def clean_name(name: str) -> str:
    """snake_case ASCII form of one column name; signs with a meaning are spelled out."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case column names; repeats get ``_2``, ``_3``, …"""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        base = clean_name(column)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)
