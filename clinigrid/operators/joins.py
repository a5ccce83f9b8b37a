"""Equi joins by name, joins that survive hot keys, and grid completion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from math import prod
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.functions import literal
from clinigrid.session import estimated_bytes, fits, literal_table

# A key with more left rows than this is split over several tasks.
HOT_ROWS = 2_000_000
# The largest keys that are split. Outside the top K a key holds less than 1/K of all rows;
# K rows of key and count are a few megabytes at most.
MAX_HOT_KEYS = 50_000
# A side is broadcast on request only after its rows and bytes were checked against these.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
# A stored row with a distinct value takes at least this many bytes, compressed; with
# HOT_ROWS it tells tables that need no counting.
SMALLEST_ROW = 1
# Salts given to rows with a missing key.
NULL_KEY_SALTS = 1024
# Grids of more cells are joined rather than built within one grouped row.
MAX_GRID_CELLS = 512


def group_key(keys: Sequence[str]) -> F.Column:
    """One never-missing key for a group, in which missing key values equal one another."""
    return F.array(*[F.col(k).cast("string") for k in keys])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all columns the two sides have in common."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the two sides have no column in common")
    return left.join(right, common, how)


def suffixed_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join that keeps both versions of clashing columns under suffixed names."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).join(
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), list(on), how
    )


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """At most MAX_HOT_KEYS keys with more than ``hot_rows`` rows, and their split count.

    The count combines before its shuffle, so the hot key itself moves as one row per
    map task.
    """
    return (
        df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), *on)
        .limit(MAX_HOT_KEYS)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_splits"))
    )


def find_hot_keys(
    df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """The hot keys as a literal table, or None if there are none.

    A table too small to hold one hot key is not counted at all. ``df`` is read once more
    for the count, so a costly one should be written first.
    """
    if estimated_bytes(df) < hot_rows * SMALLEST_ROW:
        return None
    found = hot_keys(df, on, hot_rows)
    rows = found.collect()
    if not rows:
        return None
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return literal_table(df.sparkSession, [tuple(r) for r in rows], ddl)


def salt_left(left: DataFrame, hot: DataFrame, on: Sequence[str], salt_on: Sequence[str]) -> DataFrame:
    """Add ``_salt``, spreading hot keys by a hash of columns that differ under one key."""
    splits = F.coalesce("_splits", F.lit(1))
    missing = reduce(or_, [F.col(k).isNull() for k in on])
    # Rows with a missing key match nothing, so any task may hold them.
    splits = F.when(missing, F.lit(NULL_KEY_SALTS)).otherwise(splits)
    return (
        left.join(F.broadcast(hot), list(on), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_on), splits).cast("int"))
        .drop("_splits")
    )


def salt_right(right: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Repeat the rows of hot keys once per salt; other rows stay single."""
    return (
        right.join(F.broadcast(hot), list(on), "left")
        .withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
        )
        .drop("_splits")
    )


def skew_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    salt_on: Sequence[str] | None = None, hot_rows: int = HOT_ROWS,
    counted_on: DataFrame | None = None, hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Join where one key may hold a large part of ``left``; ``right`` has few rows per key.

    Adaptive execution already splits skewed partitions when both sides are plain
    shuffles. It cannot when a side comes out of an aggregate on the join key; this
    join can, as it salts hot keys in the plan. ``salt_on`` names left columns that
    tell rows of one key apart (default: all others). ``counted_on`` is a table with the
    key counts of ``left`` that is cheaper to read, ``hot_on`` the part of the key to
    count. ``how`` is inner, left or left_semi.
    """
    on, hot_on = list(on), list(hot_on or on)
    hot = find_hot_keys(left if counted_on is None else counted_on, hot_on, hot_rows)
    if hot is None:
        return left.join(right, on, how)
    others = list(salt_on or [c for c in left.columns if c not in on])
    return (
        salt_left(left, hot, hot_on, others)
        .join(salt_right(right, hot, hot_on), [*on, "_salt"], how)
        .drop("_salt")
    )


def attach(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
    max_rows: int = BROADCAST_ROWS, salt_on: Sequence[str] | None = None,
) -> DataFrame:
    """Join a table expected to be small: broadcast if it is, salted shuffle if not.

    The check runs ``table``; pass one that is cheap to run or already written.
    """
    if fits(table, max_rows, BROADCAST_BYTES):
        return df.join(F.broadcast(table), list(on), how)
    return skew_safe_join(df, table, on, how, salt_on)


def complete(
    df: DataFrame, keys: Sequence[str], domains: Mapping[str, Sequence], fill: Mapping[str, object]
) -> DataFrame:
    """Every key with every combination of the domain values; absent cells get ``fill``.

    Domains are short literal lists, so a key's cells are built as columns of one
    grouped row and unfolded again: one shuffle of the keys, no product join. Larger
    domains unfold the distinct keys instead and join the rows to them. Missing values that
    were present before are filled as well. A cell that occurs twice is an error.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if prod(len(v) for v in domains.values()) > MAX_GRID_CELLS:
        return _complete_by_join(df, keys, domains, fill, types)
    cells = []
    for combination in product(*domains.values()):
        pairs = [(n, f"cast({literal(v)} AS {types[n]})") for n, v in zip(domains, combination)]
        here = " AND ".join(f"`{n}` <=> {v}" for n, v in pairs)
        fields = [f"'{n}', {v}" for n, v in pairs] + [
            f"'{v}', coalesce(max(CASE WHEN {here} THEN `{v}` END), cast({literal(x)} AS {types[v]}))"
            for v, x in fill.items()
        ]
        twice = f"raise_error({literal(f'cell {combination} occurs twice under one key')})"
        cells.append(
            f"CASE WHEN count_if({here}) > 1 THEN {twice} ELSE named_struct({', '.join(fields)}) END"
        )
    return (
        df.groupBy(*keys).agg(F.expr(f"array({', '.join(cells)})").alias("_cells"))
        .select(*keys, F.inline("_cells"))
    )


def _complete_by_join(df, keys, domains, fill, types) -> DataFrame:
    grid = df.select(*keys).distinct()
    for name, values in domains.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v).cast(types[name]) for v in values])))
    cell = group_key([*keys, *domains])
    twice = F.raise_error(F.lit("a cell occurs twice under one key"))
    found = df.withColumn("_cell", cell).groupBy("_cell").agg(
        F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(F.struct(*fill))).alias("_found")
    )
    joined = grid.withColumn("_cell", cell).join(found, "_cell", "left")
    return joined.select(*keys, *domains, *[
        F.coalesce(F.col("_found")[n], F.lit(v).cast(types[n])).alias(n) for n, v in fill.items()
    ])


def interval_join(
    points: DataFrame, intervals: DataFrame, at: str, first: str, last: str, days: int = 32, how: str = "inner",
) -> DataFrame:
    """Every row of ``points`` with every interval of days that holds its day ``at``; ends belong to it.

    A missing ``first`` or ``last`` leaves that side open. Intervals may overlap and be any
    number: each is dealt to the buckets of ``days`` days that it meets, of those between
    the first and last day of all points, and a point meets the intervals of its bucket
    alone. ``how`` is inner or left; a point without a day is in no interval. ``points`` is
    read twice, once for its first and last day.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")

    def bucket(day):
        return F.floor(F.unix_date(day.cast("date")) / days)

    span = points.agg(F.min(F.col(at).cast("date")), F.max(F.col(at).cast("date"))).first()
    low, high = F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")
    begin, end = F.greatest(F.coalesce(first, low), low), F.least(F.coalesce(last, high), high)
    dealt = intervals.where(begin <= end).withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    inside = (
        (F.col("_bucket") == F.col("_at_bucket"))
        & (F.col(first).isNull() | (F.col(at).cast("date") >= F.col(first)))
        & (F.col(last).isNull() | (F.col(at).cast("date") <= F.col(last)))
    )
    return points.withColumn("_at_bucket", bucket(F.col(at))).join(dealt, inside, how).drop("_bucket", "_at_bucket")
