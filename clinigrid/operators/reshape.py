"""Wide to long, long to wide, and stacking tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.functions import literal


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str, values_to: str,
    cast: str | None = None,
) -> DataFrame:
    """One row per (ids, value column); ``cast`` brings the columns to one type first."""
    if cast:
        df = df.select(*ids, *[F.col(v).try_cast(cast).alias(v) for v in values])
    return df.unpivot(list(ids), list(values), names_to, values_to)


def to_wide(
    df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence[str],
    values_from: Sequence[str], prefix: str = "",
) -> DataFrame:
    """One column per (value, name): ``<value>_<name>``, or ``<prefix><name>`` for one value.

    ``names`` is given, so the schema is fixed and no extra job lists it. A cell with two
    rows is an error instead of an arbitrary pick.
    """
    def title(value: str, name: str) -> str:
        single = bool(prefix) and len(values_from) == 1
        return f"{prefix}{name}" if single else f"{prefix}{value}_{name}"

    key = f"`{names_from}`"
    columns = [
        f"max(CASE WHEN {key} = {literal(n)} THEN `{v}` END) AS `{title(v, n)}`"
        for v in values_from for n in names
    ]
    counts = ", ".join(f"count_if({key} = {literal(n)})" for n in names)
    wide = df.groupBy(*ids).agg(
        F.expr(f"array_max(array({counts})) AS _most"), *map(F.expr, columns)
    )
    message = F.concat(F.lit(f"{names_from}: two rows for one cell under "), F.concat_ws("/", *ids))
    first = F.when(F.col("_most") > 1, F.raise_error(message)).otherwise(F.col(ids[0]))
    return wide.withColumn(ids[0], first).drop("_most")


def stack_named(tables: Mapping[str, DataFrame], id_column: str) -> DataFrame:
    """Union by name with a column telling the tables apart."""
    parts = [t.withColumn(id_column, F.lit(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
