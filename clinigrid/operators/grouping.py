"""Grouped statistics that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinigrid.functions import max_strict, percent
from clinigrid.operators.joins import attach, group_key, skew_safe_join
from clinigrid.session import literal_table, materialise, row_count_within

# Up to this many (group, value) rows the built-in exact percentile holds its state easily.
PERCENTILE_ROWS = 1_000_000
# Partition number of monotonically_increasing_id sits above this bit.
_PARTITION_BIT = 33


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column],
    salt_on: Sequence[str] | None = None,
) -> DataFrame:
    """Group aggregates next to every row, for groups of any size.

    A window would sort a whole group in one task; this aggregates with map-side
    combining and joins the one row per group back. The rows are written first, as they
    are read twice. Missing keys are a group like any other.
    """
    df = materialise(df.withColumn("_group", group_key(keys)), "rows")
    table = df.groupBy("_group").agg(*[c.alias(n) for n, c in stats.items()])
    return skew_safe_join(df, table, ["_group"], "left", salt_on).drop("_group")


def share_in_small_groups(
    df: DataFrame, keys: Sequence[str], value: str, total: str, share: str
) -> DataFrame:
    """Group total and percentage; only for groups whose rows a fixed domain bounds."""
    group = Window.partitionBy(*keys)
    return df.withColumn(total, F.sum(value).over(group)).withColumn(share, percent(value, total))


def top_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that hold their group's maximum, ties kept; a missing value empties its group.

    The rows are written first: sums of doubles that are made twice need not be equal.
    Missing keys are a group like any other. There may be many ties, so the group's maximum
    is salted rather than met by a semi join.
    """
    df = materialise(df.withColumn("_group", group_key(keys)), "rows")
    best = df.groupBy("_group").agg(max_strict(value).alias("_best"))
    others = [c for c in df.columns if c != "_group"]
    return skew_safe_join(df, best, ["_group"], "inner", others).where(
        F.col(value) == F.col("_best")
    ).drop("_group", "_best")


def sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Row counts per key, largest first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def cube_slice(
    df: DataFrame, drilldowns: Sequence[str], measures: Sequence[str],
    cuts: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Sum of measures over drilldown columns, within member cuts."""
    for column, members in (cuts or {}).items():
        df = df.where(F.col(column).isin(*members))
    return df.groupBy(*drilldowns).agg(*[F.sum(m).alias(m) for m in measures])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number rows 1, 2, … in a global order without a single-task window.

    Range-partitioned sort, written once so positions are fixed; then each partition's
    size (one row per partition) gives the offset of the next.
    """
    ids = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(ids, "numbered").withColumn(
        "_part", F.shiftright("_id", _PARTITION_BIT)
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, seen = [], 0
    for row in counts:
        offsets.append((row["_part"], seen))
        seen += row["n"]
    table = literal_table(df.sparkSession, offsets, "_part long, _before long")
    position = F.col("_id").bitwiseAND(F.lit(2**_PARTITION_BIT - 1))
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(name, (F.col("_before") + position + 1).cast("long"))
        .drop("_id", "_part", "_before")
    )


def ordinal_code(df: DataFrame, label: str, name: str) -> DataFrame:
    """1-based position of each row's label among the sorted distinct labels.

    Labels are numbered by a distributed sort, NaN last. A missing label has no code.
    ``df`` is read twice.
    """
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    return skew_safe_join(df, numbered(labels, [label], name), [label], "left")


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
    percentile_rows: int = PERCENTILE_ROWS,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per group: ``*by, prob, value``.

    Missing keys are a group like any other. Values are first counted per distinct value. A short list goes through the built-in
    ``percentile``; a long one through a distributed rank selection.
    """
    counted = materialise(
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")),
        "values",
    )
    if row_count_within(counted, percentile_rows):
        found = counted.groupBy(*by).agg(
            F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), F.col("_n"))
            .alias("_q")
        )
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return found.select(
            *by, F.inline(F.arrays_zip(wanted.alias("prob"), F.col("_q").alias(value)))
        )
    return _ranked_quantiles(counted, value, probs, list(by))


def _ranked_quantiles(
    counted: DataFrame, value: str, probs: Sequence[float], by: list[str]
) -> DataFrame:
    """Quantiles of (group, value, count) rows by range-partitioned running counts."""
    ordered = counted.orderBy(*by, value).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(ordered, "ranked").withColumns({
        "_part": F.shiftright("_id", _PARTITION_BIT), "_group": group_key(by) if by else F.array(),
    }).drop("_id")
    # One row per (group, partition the group touches): small, so a window is safe.
    blocks = placed.groupBy("_group", "_part").agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy("_group")
    running = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    position = (F.col("_total") - 1) * F.col("prob")
    blocks = materialise(
        blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(group)),
        "blocks",
    )
    wanted = (
        blocks.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .where(
            (F.col("_rank") >= F.col("_before"))
            & (F.col("_rank") < F.col("_before") + F.col("_rows"))
        )
        .withColumn("_h", position)
        .drop("_rows", "_total")
    )
    in_block = Window.partitionBy("_group", "_part").orderBy(value)
    candidates = (
        placed.join(wanted.select("_group", "_part", "_before").distinct(), ["_group", "_part"])
        .withColumn("_stop", F.col("_before") + F.sum("_n").over(in_block))
        .drop("_before")
    )
    low = F.min(F.col(value).cast("double"))
    high = F.max(F.col(value).cast("double"))
    fraction = F.max(F.col("_h") - F.floor("_h"))
    return (
        candidates.join(wanted.drop("_before"), ["_group", "_part"])
        .where((F.col("_rank") < F.col("_stop")) & (F.col("_rank") >= F.col("_stop") - F.col("_n")))
        .groupBy(*by, "prob")
        .agg((low + (high - low) * fraction).alias(value))
    )


def binscatter(
    df: DataFrame, x: str, y: str, nbins: int = 20, by: str | None = None,
    x_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Mean of y in equal-frequency bins of x, with a normal 95 % interval.

    ``df`` is read twice, for the breakpoints and for the bins. ``bin`` counts the
    breakpoints below x; a missing ``by`` is a group of its own. ``x_range`` limits the bins shown, not the rows they are made from.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    probs = [i / nbins for i in range(1, nbins)]
    groups = [by] if by else []
    points = quantiles(rows, x, probs, groups)
    number = " + ".join(["0"] + [f"if(`{x}` > get(_cuts, {i}), 1, 0)" for i in range(nbins - 1)])
    if by:
        cuts = points.groupBy(group_key(groups).alias("_group")).agg(
            F.array_distinct(F.array_sort(F.collect_list(x))).alias("_cuts")
        )
        rows = rows.withColumn("_group", group_key(groups))
        rows = attach(rows, materialise(cuts, "cuts"), ["_group"], "inner", salt_on=[x, y])
    else:
        found = sorted(r[0] for r in points.select(x).distinct().collect())
        rows = rows.withColumn("_cuts", F.array(*map(F.lit, found)))
    spread = 1.96 * F.col("sd_y") / F.sqrt("n")
    bins = (
        rows.withColumn("bin", F.expr(f"int({number})"))
        .groupBy(*groups, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
            F.stddev_samp(y).alias("sd_y"),
        )
        .withColumn("ci_low", F.col("mean_y") - spread)
        .withColumn("ci_high", F.col("mean_y") + spread)
    )
    return bins.where(F.col("mean_x").between(*x_range)) if x_range else bins
