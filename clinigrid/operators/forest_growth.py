"""Random forests of many scenarios, folds and settings grown together, level by level.

Every tree of every forest is a group of one table, so a level is one pass over all of
them: rows sorted by tree and node are counted by tried column and bin, the best split of each
node is kept, and rows move on to its children. Which rows a tree has drawn and which columns a node
tries are hashes, so nothing is drawn in the driver and any partitioning gives the same trees.

Settings cost nothing of their own. A tree of a smaller depth, or one that asks for more gain
of a split, is the same tree cut short; so each held-out row notes what it passes on its way
down, and every setting's prediction is read off that.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator, Mapping, Sequence
from contextvars import copy_context
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from clinigrid.operators.forest import (
    MAX_DEPTH, MIN_NODE, UNTUNED, ForestSettings, fold_number, split_flag, summarise_folds,
)
from clinigrid.session import drop_stage, literal_table, materialise, write_stage

# Columns are binned once, at so many equally filled bins at most.
BINS = 32
# The model that learns from all training rows of a scenario.
WHOLE = -1
# Labels are added as whole numbers, so that the order of tasks cannot change a split.
LABEL_STEPS = 1 << 30
# Values of the Poisson distribution of mean 1, up to which it is drawn: beyond lies one draw in 10 million.
POISSON_VALUES = 10
NODE = ["model", "tree", "node"]
# Trees dealt out together, and rows that a task of a level gets, about.
TREE_BLOCK = 20
ROWS_A_TASK = 100_000
# Rows that are counted at once: few enough for a task's memory, and for exact sums of labels as doubles.
ROWS_AT_ONCE = 4_000
# Tasks get the function of a level by value: executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Growth:
    """All tables of one growth; see ``grow``."""

    rows: DataFrame
    models: DataFrame
    nodes: DataFrame
    predictions: DataFrame
    grid: DataFrame
    names: Sequence[str]
    elapsed_seconds: float


def bag_weight(draw, model, tree, seed: int) -> Column:
    """How often a tree has drawn a row: Poisson with mean 1, by the hash of both."""
    return times_drawn(bag_hash(draw, model, tree, seed))


def bag_hash(draw, model, tree, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("bag"), draw, model, tree)


def times_drawn(hashed: Column) -> Column:
    """The weight that a hash stands for; it is compared often, so it should be a column already."""
    u = F.pmod(hashed, F.lit(1 << 53)) / float(1 << 53)
    below, term = 0.0, 2.718281828459045 ** -1
    steps = []
    for k in range(POISSON_VALUES):
        below += term
        steps.append((u >= below).cast("int"))
        term /= k + 1
    return sum(steps[1:], steps[0])


def tried_columns(model, tree, node, columns: int, tried: int, seed: int) -> Column:
    """Numbers of the columns that a node tries, ``tried`` of ``columns``, by their hashes."""
    ranked = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.struct(
        F.xxhash64(F.lit(seed), F.lit("columns"), model, tree, node, c).alias("h"), c.alias("c")
    ))
    return F.transform(F.slice(F.sort_array(ranked), 1, min(tried, columns)), lambda s: s["c"])


def _parts(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def prepared(table: DataFrame, names: Sequence[str], settings: ForestSettings, by: str) -> DataFrame:
    """Stored rows (id, by, draw, y, label, train, fold, bins) of the complete rows of ``table``.

    ``y`` is the label as a whole number of steps of its scenario's range, ``bins`` how many
    of a column's cuts lie below the value, one byte a column. Cuts are quantiles of the scenario's training rows.
    """
    rows = materialise(table.dropna("any").select(
        F.monotonically_increasing_id().alias("id"), F.col(by),
        F.xxhash64(*[F.col(k).cast("string") for k in settings.keys]).alias("draw"),
        F.col(settings.label).cast("double").alias("label"),
        F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x"),
        split_flag(settings.keys, seed=settings.seed).alias("train"),
        fold_number(settings.keys, settings.folds, settings.seed).alias("fold"),
    ), "forest-rows")
    shares = [k / BINS for k in range(1, BINS)]
    cuts = rows.where("train").select(by, F.posexplode("x").alias("c", "v")).groupBy(by, "c").agg(
        F.array_sort(F.array_distinct(F.percentile_approx("v", F.lit(shares), F.lit(10 * BINS)))).alias("cuts")
    ).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "cuts"))), lambda s: s["cuts"]).alias("cuts"))
    span = rows.groupBy(by).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    known = cuts.join(span, by)
    y = F.round((F.col("label") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * LABEL_STEPS)
    bins = F.transform("x", lambda v, c: F.lpad(F.hex(F.size(F.filter(F.get("cuts", c), lambda k: k < v))), 2, "0"))
    return materialise(rows.join(known, by).select(
        "id", by, "draw", "label", "train", "fold", "low", "high",
        F.coalesce(y.cast("bigint"), F.lit(0).cast("bigint")).alias("y"), F.unhex(F.array_join(bins, "")).alias("bins"),
    ), "forest-rows")


def model_table(rows: DataFrame, settings: ForestSettings, by: str) -> DataFrame:
    """(model, by, fold): one model per scenario and fold that has training rows, and one for all of them.

    A scenario needs two folds with rows at least.
    """
    found = rows.where("train").select(by, "fold").distinct().orderBy(by, "fold").collect()
    folds: dict = {}
    for r in found:
        folds.setdefault(r[by], []).append(r["fold"])
    for name, held in folds.items():
        if len(held) < 2:
            raise ValueError(f"too few complete rows to hold out a fold: {name}")
    pairs = [(name, fold) for name, held in folds.items() for fold in [WHOLE, *held]]
    kind = rows.schema[by].dataType.simpleString()
    return literal_table(rows.sparkSession, [(i, *p) for i, p in enumerate(pairs)], f"model int, {by} {kind}, of_fold int")


def tried_at(node: Column, columns: int, settings: ForestSettings) -> Column:
    """The columns that a node of a level tries, in ascending order."""
    return F.sort_array(
        tried_columns(F.col("model"), F.col("tree"), node, columns, settings.columns_per_split, settings.seed)
    )


def dealt(rows: DataFrame, models: DataFrame, columns: int, settings: ForestSettings, by: str) -> DataFrame:
    """(NODE, id, w, y, bins, held, floor, tried): rows at the roots of all trees, as often as each has drawn them.

    A model's own held-out rows come along with weight 0: the rows of its fold, or the
    test rows for the model of all training rows.
    """
    of_fold = F.col("of_fold")
    held = F.when(of_fold == WHOLE, ~F.col("train")).otherwise(F.col("train") & (of_fold == F.col("fold")))
    learned = F.col("train") & (F.col("fold") != of_fold)
    placed = rows.join(F.broadcast(models), by).withColumn("held", held).where(held | learned)
    # Few rows become very many, so blocks of trees are dealt to tasks first.
    blocks = F.sequence(F.lit(0), F.lit(settings.trees - 1), F.lit(TREE_BLOCK))
    last = F.least(F.col("block") + TREE_BLOCK, F.lit(settings.trees)) - 1
    parts = _parts(placed.count() * settings.trees)
    root = F.lit(1).cast("bigint")
    roots = models.select("model", F.explode(blocks).alias("block")).repartition(parts, "model", "block").select(
        "model", F.explode(F.sequence(F.col("block"), last)).alias("tree")
    ).select("model", "tree", tried_at(root, columns, settings).alias("tried"))
    # The hash comes out of the same generator as the tree: a plain expression would be worked out at every comparison.
    drawn = F.transform(F.sequence(F.col("block"), last), lambda t: F.struct(
        t.alias("tree"), bag_hash(F.col("draw"), F.col("model"), t, settings.seed).alias("hashed")
    ))
    trees = placed.select("model", F.explode(blocks).alias("block"), "id", "draw", "y", "bins", "held").repartition(
        parts, "model", "block"
    ).select("model", F.inline(drawn), "id", "y", "bins", "held")
    w = F.when(F.col("held"), 0).otherwise(times_drawn(F.col("hashed")))
    return trees.withColumn("w", w).where("held or w > 0").join(roots, ["model", "tree"]).select(
        "model", "tree", root.alias("node"), "id", "w", "y", "bins", "held", F.lit(float("inf")).alias("floor"), "tried",
    )


def _split_sorted(batches: Iterator[pa.RecordBatch], columns: int, tried: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One row per node from rows sorted by node: NODE, weight, total, floor, c, bin, gain, left.

    Rows are counted by tried column and bin a batch at a time. The counts of a batch's
    last node go on to the next batch, so a node may have any number of rows.
    """
    def told(key, floor, weight, total, cols, counts):
        wl, sl = counts.cumsum(axis=3)
        whole, full = weight[:, None, None], total[:, None, None]

        def part(s, w):
            s = s.astype("f8")
            return s * s / w

        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (part(sl, wl) + part(full - sl, whole - wl) - part(full, whole)) / whole
        gain = np.where((wl >= MIN_NODE) & (whole - wl >= MIN_NODE) & (gain > 0), gain, 0.0)
        gain = gain.reshape(len(key), -1)
        # Of equal gains the first column and bin win: bins that no row has come after the one they equal.
        best = gain.argmax(axis=1)
        at = np.arange(len(key))
        none = (gain[at, best] <= 0) | last
        return pa.RecordBatch.from_arrays([
            pa.array(key[:, 0].astype("i4")), pa.array(key[:, 1].astype("i4")), pa.array(key[:, 2]),
            pa.array(weight), pa.array(total), pa.array(floor), pa.array(cols[at, best // BINS].astype("i4"), mask=none),
            pa.array((best % BINS).astype("i4"), mask=none), pa.array(gain[at, best], mask=none),
            pa.array(wl.reshape(len(key), -1)[at, best], mask=none),
        ], names=[*NODE, "weight", "total", "floor", "c", "bin", "gain", "left"])

    held = None
    pieces = (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE))
    for b in pieces:
        n = b.num_rows
        key = np.stack([b.column(c).to_numpy().astype("i8") for c in NODE], axis=1)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        node = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
        w, s = b.column("w").to_numpy().astype("i8"), b.column("s").to_numpy()
        floor = b.column("floor").to_numpy()[first]
        bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), "u1").reshape(n, columns)
        cols = np.array(b.column("tried").take(pa.array(first)).to_pylist(), "i8").reshape(len(first), tried)
        cell = ((node * tried)[:, None] + np.arange(tried)) * BINS + bins[np.arange(n)[:, None], cols[node]]
        counts = np.stack([
            np.bincount(cell.ravel(), np.repeat(v, tried).astype("f8"), len(first) * tried * BINS).astype("i8")
            for v in (w, s)
        ]).reshape(2, len(first), tried, BINS)
        weight, total = np.add.reduceat(w, first), np.add.reduceat(s, first)
        now = [key[first], floor, weight, total, cols]
        if held is not None:
            if (held[0][0] == now[0][0]).all():
                weight[0] += held[2][0]
                total[0] += held[3][0]
                counts[:, 0] += held[5][:, 0]
            else:
                yield told(*held)
        if len(first) > 1:
            yield told(*[x[:-1] for x in now], counts[:, :-1])
        held = [*[x[-1:].copy() for x in now], counts[:, -1:].copy()]
    if held is not None:
        yield told(*held)


def best_splits(at: DataFrame, columns: int, settings: ForestSettings, depth: int, parts: int) -> DataFrame:
    """The nodes of a level: NODE, depth, weight, total, floor, the best split's column, bin and gain, and its left weight.

    A split leaves MIN_NODE draws on either side and lowers the variance; of equal gains
    the first column and bin win. ``floor`` is the least gain on the way to the node.
    """
    tried, last = min(settings.columns_per_split, columns), depth >= MAX_DEPTH

    def split(batches):
        return _split_sorted(batches, columns, tried, last)

    rows = at.select(*NODE, "w", (F.col("w") * F.col("y")).alias("s"), "floor", "bins", "tried")
    return rows.repartition(parts, "model", "tree").sortWithinPartitions(*NODE).mapInArrow(
        split,
        "model int, tree int, node bigint, weight bigint, total bigint, floor double, c int, bin int, gain double, "
        "`left` bigint",
    ).withColumn("depth", F.lit(depth))


def grid_table(spark, settings: ForestSettings) -> DataFrame:
    """(config, max_depth, min_info_gain), with the forest that no setting cuts short as well."""
    cells = [(i, c["maxDepth"], float(c["minInfoGain"])) for i, c in enumerate(settings.grid)]
    if not any(d == MAX_DEPTH and g == 0.0 for _, d, g in cells):
        cells.append((UNTUNED, MAX_DEPTH, 0.0))
    return literal_table(spark, cells, "config int, max_depth int, min_info_gain double")


def grow(table: DataFrame, settings: ForestSettings, by: str = "scenario") -> Growth:
    """All forests of ``table``: per value of ``by`` one per fold and one of all training rows, for every setting.

    ``rows`` are the complete rows, ``models`` names them, ``nodes`` are all trees,
    ``predictions`` (model, id, config, prediction) are those of each model's held-out
    rows, averaged over its trees. Gains are told in the label's own unit.
    """
    started = time.perf_counter()
    spark = table.sparkSession
    names = [c for c in table.columns if c not in settings.exclude and c not in (settings.label, by)]
    rows = prepared(table, names, settings, by)
    models = model_table(rows, settings, by)
    scales = rows.groupBy(by).agg(
        F.min("low").alias("low"), ((F.max("high") - F.min("low")) / LABEL_STEPS).alias("unit")
    ).join(F.broadcast(models), by).select("model", "low", "unit")
    # One row a model, so its size is bounded by the settings.
    scales = F.broadcast(materialise(scales, "forest-scales"))

    columns = len(names)
    seen_rows = Observation()
    at, held = write_stage(
        dealt(rows, models, columns, settings, by).observe(seen_rows, F.count(F.lit(1)).alias("n")), "forest-level"
    )
    nodes, visits = None, None
    pool = ThreadPool(1)
    for depth in range(MAX_DEPTH + 1):
        parts = _parts(seen_rows.get["n"])
        # Floors are carried in the label's unit.
        split = materialise(best_splits(at, columns, settings, depth, parts).join(scales, "model").select(
            *NODE, "depth", "weight", "floor", "c", "bin", (F.col("gain") * F.col("unit") * F.col("unit")).alias("gain"),
            (F.col("low") + F.try_divide("total", "weight") * F.col("unit")).alias("value"), "left",
        ), "forest-nodes")
        here = split.drop("left")
        nodes = here if nodes is None else nodes.unionByName(here)
        seen = at.where("held").select(*NODE, "id").join(
            here.select(*NODE, "depth", "floor", "gain", "value"), NODE
        ).select("model", "id", "depth", "floor", "gain", "value")
        # What held-out rows pass on a level, folded over trees: no row a tree is kept.
        # Nothing on the way down needs it, so it runs beside the move to the next level.
        passed = pool.apply_async(inheritable_thread_target(spark)(partial(
            copy_context().run, materialise, _stops(seen, grid_table(spark, settings)), "forest-passed"
        )))
        right = (F.ascii(F.expr("cast(substring(bins, c + 1, 1) as string)")) > F.col("bin")).cast("int")
        # Children too light to be split try nothing: their first columns stand in.
        nothing = F.sequence(F.lit(0), F.lit(min(settings.columns_per_split, columns) - 1))

        def tried(side, weight):
            return F.when(weight >= 2 * MIN_NODE, tried_at(F.col("node") * 2 + side, columns, settings)).otherwise(nothing)

        parents = split.where("gain is not null").select(
            *NODE, "c", "bin", "gain", F.col("floor").alias("above"),
            tried(0, F.col("left")).alias("tried0"), tried(1, F.col("weight") - F.col("left")).alias("tried1"),
        )
        seen_rows = Observation()
        at, fresh = write_stage(at.drop("tried").join(parents, NODE).withColumn("right", right).select(
            "model", "tree", (F.col("node") * 2 + F.col("right")).alias("node"), "id", "w", "y", "bins", "held",
            F.least("above", "gain").alias("floor"),
            F.when(F.col("right") == 0, F.col("tried0")).otherwise(F.col("tried1")).alias("tried"),
        ).observe(seen_rows, F.count(F.lit(1)).alias("n")), "forest-level")
        passed = passed.get()
        visits = passed if visits is None else visits.unionByName(passed)
        drop_stage(spark, held)
        held = fresh
        if not seen_rows.get["n"]:
            break
    pool.close()
    predictions = materialise(visits.groupBy("model", "id", "config").agg(
        (F.sum("s") / F.sum("n")).alias("prediction")
    ), "forest-predictions")
    return Growth(
        rows, models, nodes, predictions, grid_table(spark, settings), names, time.perf_counter() - started
    )


def _stops(seen: DataFrame, grid: DataFrame) -> DataFrame:
    """(model, id, config, s, n) of the settings for which rows come to rest at a level's nodes.

    A row has come so far if all gains on the way were enough and the depth is allowed;
    it rests where the depth is reached, no split is left or the split's gain is too small.
    """
    cells = F.array(*[
        F.struct(F.lit(r["config"]).alias("config"), F.lit(r["max_depth"]).alias("d"), F.lit(r["min_info_gain"]).alias("g"))
        for r in grid.collect()
    ])
    depth, floor, gain = F.col("depth"), F.col("floor"), F.col("gain")
    resting = F.filter(cells, lambda s: (floor >= s["g"]) & (depth <= s["d"]) & (
        (depth == s["d"]) | gain.isNull() | (gain < s["g"])
    ))
    return seen.select("model", "id", "value", F.explode(resting).alias("s")).groupBy("model", "id", "s.config").agg(
        F.sum("value").alias("s"), F.count("value").alias("n")
    )


def scores(growth: Growth, by: str = "scenario") -> DataFrame:
    """(by, of_fold, config, metric, estimate): error and squared correlation of every model and setting."""
    label, prediction = F.col("label"), F.col("prediction")
    error = F.sqrt(F.avg(F.pow(label - prediction, F.lit(2.0))))
    # Constant predictions have no correlation: missing, not an error. Rounding noise is no spread.
    spread = F.stddev_pop("label") * F.stddev_pop("prediction")
    r = F.try_divide(F.covar_pop("label", "prediction"), F.when(spread > 1e-12 * F.var_pop("label"), spread))
    told = growth.predictions.join(growth.rows.select("id", "label"), "id").groupBy("model", "config").agg(
        error.alias("rmse"), (r * r).alias("rsq")
    )
    return told.join(F.broadcast(growth.models), "model").unpivot(
        [by, "of_fold", "config"], ["rmse", "rsq"], "metric", "estimate"
    )


@dataclass
class Tuned:
    """Fold metrics by setting, the best setting, its test metrics and its importances."""

    growth: Growth
    folds: DataFrame
    best: DataFrame
    test: DataFrame
    importance: DataFrame
    elapsed_seconds: float


def tuned(growth: Growth, by: str = "scenario") -> Tuned:
    """Per scenario the setting of the largest mean squared correlation over folds, the first of equals."""
    scored = materialise(scores(growth, by), "forest-scores")
    folds = summarise_folds(scored.where(F.col("of_fold") != WHOLE), [by, "config"]).join(
        F.broadcast(growth.grid), "config"
    )
    folds = materialise(folds, "forest-folds")
    # Sums of predictions may differ in their last digits, so nearly equal means are equal.
    rank = F.struct((-F.round(F.coalesce("mean", F.lit(-1.0)), 9)).alias("less"), "config", "max_depth", "min_info_gain")
    best = folds.where((F.col("metric") == "rsq") & (F.col("config") != UNTUNED)).groupBy(by).agg(
        F.min(rank).alias("b")
    ).select(by, "b.config", "b.max_depth", "b.min_info_gain")
    best = materialise(best, "forest-best")
    test = scored.where(F.col("of_fold") == WHOLE).join(F.broadcast(best.select(by, "config")), [by, "config"]).select(
        by, "metric", "estimate"
    )
    return Tuned(growth, folds, best, test, importance(growth, best, by), growth.elapsed_seconds)


def importance(growth: Growth, best: DataFrame, by: str = "scenario") -> DataFrame:
    """(by, variable, importance) of the models of all training rows: what a column's splits gain, by weight.

    A tree's gains sum to 1, then a forest's; columns that no split took have 0.
    """
    whole = F.broadcast(growth.models.where(F.col("of_fold") == WHOLE).join(best, by))
    kept = growth.nodes.where("gain is not null").join(whole, "model").where(
        (F.col("floor") >= F.col("min_info_gain")) & (F.col("gain") >= F.col("min_info_gain"))
        & (F.col("depth") < F.col("max_depth"))
    )
    gained = kept.groupBy(by, "tree", "c").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    # A tree has as many columns at most as there are features.
    share = F.col("g") / F.sum("g").over(Window.partitionBy(by, "tree"))
    summed = gained.withColumn("g", share).groupBy(by, "c").agg(F.sum("g").alias("g"))
    share = F.col("g") / F.sum("g").over(Window.partitionBy(by))
    found = summed.withColumn("g", share)
    every = best.select(by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.lit(n).alias("variable")) for i, n in enumerate(growth.names)
    ])))
    return every.join(found, [by, "c"], "left").select(
        by, "variable", F.coalesce("g", F.lit(0.0)).alias("importance")
    ).orderBy(by, F.desc("importance"), "variable")


def grow_scenarios(
    table: DataFrame, scenarios: Mapping[str, Sequence[str]], settings: ForestSettings, wave: str = "ola"
) -> Tuned:
    """The forests of all scenarios of waves in one growth."""
    pairs = [(name, ola) for name, olas in scenarios.items() for ola in olas]
    named = literal_table(table.sparkSession, pairs, f"scenario string, {wave} string")
    return tuned(grow(table.join(F.broadcast(named), wave), settings))


def metric_rows(found: Tuned) -> DataFrame:
    """Fold metrics of all settings (``set`` is folds, or untuned for the forest without one) and test metrics."""
    untuned = (F.col("max_depth") == MAX_DEPTH) & (F.col("min_info_gain") == 0)
    names = ["scenario", "metric", "mean", "n", "std_err"]
    tuning = found.folds.where(F.col("config") != UNTUNED).withColumn("set", F.lit("folds"))
    plain = found.folds.where(untuned).select(*names).withColumn("set", F.lit("untuned"))
    test = found.test.join(F.broadcast(found.best), "scenario").withColumnRenamed("estimate", "mean").withColumn("set", F.lit("test"))
    return tuning.unionByName(plain, allowMissingColumns=True).unionByName(test, allowMissingColumns=True).withColumn(
        "elapsed_seconds", F.lit(found.elapsed_seconds)
    )
