"""Forests grown together against a plain forest of the same draws, and runs that are kept."""

import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import bench
from clinigrid import session
from clinigrid.operators import forest
from clinigrid.operators import forest_growth as growth
from clinigrid.plans import catalogue
from clinigrid.sources import results

GRID = [{"maxDepth": d, "minInfoGain": g} for d in (0, 1, 3, 30) for g in (0.0, 0.05, 2.0)]
SETTINGS = forest.ForestSettings(trees=6, folds=3, columns_per_split=2, grid=GRID)


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    data = [
        (f"{i % 70:04}", "03_ola_2" if i < 70 else "05_ola_3", 1, 1, 3 * a + draw.gauss(0, 0.3), a, float(draw.randint(0, 3)), draw.random(), 7.0)
        for i, a in enumerate(draw.random() for _ in range(140))
    ] + [("9999", "03_ola_2", 1, 1, None, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(
        data, "CVEGEO string, ola string, casos_totales int, defunciones int, cfr double, a double, b double, c double, d double")


@pytest.fixture(scope="module")
def grown(table):
    return growth.grow_scenarios(table, {"A": ("03_ola_2",), "B": ("05_ola_3",)}, SETTINGS)


def plain_tree(rows, weights, tried, held):
    """Nodes by number, and per held-out row (depth, floor, gain, value) on its way down."""
    todo, passed, nodes = [(1, 0, float("inf"), rows, held)], {r["id"]: [] for r in held}, {}
    while todo:
        node, depth, floor, mine, visiting = todo.pop()
        w = np.array([weights[r["id"]] for r in mine])
        y = np.array([r["y"] for r in mine], dtype=object)
        total, size = sum(w * y), int(w.sum())
        best = None
        for c in tried(node) if size >= 10 and depth < 30 else ():
            at = np.array([r["bins"][c] for r in mine])
            for cut in sorted(set(at)):
                wl, sl = int(w[at <= cut].sum()), sum((w * y)[at <= cut])
                if wl >= 5 and size - wl >= 5:
                    gain = (float(sl) * sl / wl + float(total - sl) * (total - sl) / (size - wl) - float(total) * total / size) / size
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, c, cut
        nodes[node] = best and (best[1], best[2])
        for r in visiting:
            passed[r["id"]].append((depth, floor, best and best[0], total / size))
        if best:
            gain, c, cut = best
            for side in (0, 1):
                part = [[r for r in group if (r["bins"][c] > cut) == side] for group in (mine, visiting)]
                todo.append((2 * node + side, depth + 1, min(floor, gain), *part))
    return nodes, passed


def test_equals_a_plain_forest(spark, grown):
    g = grown.growth
    rows = [r.asDict() for r in g.rows.collect()]
    columns = len(g.names)
    assert g.names == ["a", "b", "c", "d"] and len(rows) == 140
    predictions = {(r["model"], r["id"], r["config"]): r["prediction"] for r in g.predictions.collect()}
    nodes = {(r["model"], r["tree"], r["node"]): r["gain"] is not None and (r["c"], r["bin"]) for r in g.nodes.collect()}
    expected, plain_nodes = {}, {}
    for model in g.models.collect():
        mine = [r for r in rows if r["scenario"] == model["scenario"]]
        if model["of_fold"] == growth.WHOLE:
            train, held = [r for r in mine if r["train"]], [r for r in mine if not r["train"]]
        else:
            train = [r for r in mine if r["train"] and r["fold"] != model["of_fold"]]
            held = [r for r in mine if r["train"] and r["fold"] == model["of_fold"]]
        unit = (mine[0]["high"] - mine[0]["low"]) / growth.LABEL_STEPS
        for tree in range(SETTINGS.trees):
            drawn = spark.createDataFrame([(r["id"], r["draw"]) for r in train], "id bigint, draw bigint").select(
                "id", growth.bag_weight(F.col("draw"), F.lit(model["model"]), F.lit(tree), SETTINGS.seed).alias("w"))
            weights = {r["id"]: r["w"] for r in drawn.collect()}
            bag = [r for r in train if weights[r["id"]]]
            ids = spark.range(1, 128).select("id", growth.tried_columns(
                F.lit(model["model"]), F.lit(tree), F.col("id"), columns, 2, SETTINGS.seed).alias("c"))
            tried = {r["id"]: sorted(r["c"]) for r in ids.collect()}
            assert all(len(set(c)) == 2 for c in tried.values())
            found, passed = plain_tree(bag, weights, tried.__getitem__, held)
            plain_nodes.update({(model["model"], tree, n): s or False for n, s in found.items()})
            for i, way in passed.items():
                for config, cell in enumerate(GRID):
                    depth, gain = cell["maxDepth"], cell["minInfoGain"] / unit**2
                    rest = next(v for d, floor, own, v in way if floor >= gain and d <= depth
                                and (d == depth or own is None or own < gain))
                    expected.setdefault((model["model"], i, config), []).append(mine[0]["low"] + rest * unit)
    assert nodes == plain_nodes
    assert predictions.keys() == expected.keys()
    for key, values in expected.items():
        assert predictions[key] == pytest.approx(np.mean(values), abs=1e-9)


def test_metrics_best_setting_and_importance(grown):
    rows = growth.metric_rows(grown).collect()
    assert {r["set"] for r in rows} == {"folds", "untuned", "test"}
    by = {(r["scenario"], r["config"], r["metric"]): r for r in rows if r["set"] == "folds"}
    assert len(by) == 2 * len(GRID) * 2
    for best in grown.best.collect():
        means = [by[best["scenario"], c, "rsq"]["mean"] for c in range(len(GRID))]
        top = max(m for m in means if m is not None)
        assert best["config"] == next(c for c, m in enumerate(means) if m is not None and m >= top - 1e-9)
        assert by[best["scenario"], 9, "rsq"]["mean"] > 0.5
        assert by[best["scenario"], 0, "rsq"]["mean"] is None  # One node predicts one value.
    plain = {(r["scenario"], r["metric"]): r["mean"] for r in rows if r["set"] == "untuned"}
    assert plain[("A", "rsq")] == by["A", 9, "rsq"]["mean"]
    told = {(r["scenario"], r["variable"]): r["importance"] for r in grown.importance.collect()}
    assert len(told) == 8 and max(told, key=told.get)[1] == "a" and told["A", "d"] == 0
    assert sum(v for (s, _), v in told.items() if s == "A") == pytest.approx(1)


def test_growth_does_not_depend_on_partitions(table, grown):
    again = growth.grow_scenarios(table.repartition(11), {"A": ("03_ola_2",), "B": ("05_ola_3",)}, SETTINGS)
    best, other = ({r["scenario"]: r["config"] for r in x.best.collect()} for x in (grown, again))
    assert best == other
    a, b = ({(r["scenario"], r["metric"]): r["estimate"] for r in x.test.collect()} for x in (grown, again))
    assert a == pytest.approx(b)


def test_a_node_may_lie_in_several_batches():
    """Counts of a batch's last node go on to the next, so cuts between batches change nothing."""
    draw, columns, tried = random.Random(9), 4, [0, 2, 3]
    rows = [(0, t, n, draw.choice([0, 1, 1, 2]), draw.randrange(1 << 30)) for t in range(3) for n in (2, 3, 9)
            for _ in range(draw.choice([1, 8, 60]))]
    batch = pa.table({
        "model": pa.array([r[0] for r in rows], "int32"), "tree": pa.array([r[1] for r in rows], "int32"),
        "node": pa.array([r[2] for r in rows], "int64"), "w": pa.array([r[3] for r in rows], "int32"),
        "s": pa.array([r[3] * r[4] for r in rows], "int64"), "floor": pa.array([1.0] * len(rows)),
        "bins": pa.array([bytes(draw.randrange(growth.BINS) for _ in range(columns)) for _ in rows]),
        "tried": pa.array([tried] * len(rows), pa.list_(pa.int32())),
    }).to_batches()[0]

    def found(size):
        pieces = [batch.slice(i, size) for i in range(0, len(rows), size)]
        return [r for b in growth._split_sorted(iter(pieces), columns, len(tried), False) for r in b.to_pylist()]

    whole = found(len(rows))
    assert len(whole) == 9 and any(r["c"] is not None for r in whole) and any(r["c"] is None for r in whole)
    assert found(1) == found(7) == whole


def test_a_level_is_dealt_to_tasks_by_its_rows(table, monkeypatch):
    """Rows that pack well are few bytes, by which Spark alone would give all of them to one task."""
    monkeypatch.setattr(growth, "ROWS_A_TASK", 100)
    named = table.withColumn("scenario", F.lit("A"))
    rows = growth.prepared(named, ["a", "b", "c", "d"], SETTINGS, "scenario")
    at = growth.dealt(rows, growth.model_table(rows, SETTINGS, "scenario"), 4, SETTINGS, "scenario")
    assert at.select("model", "tree", "id").distinct().count() == at.count() > 1000
    best = growth.best_splits(at, 4, SETTINGS, 0, growth._parts(at.count()))
    assert best.rdd.getNumPartitions() > 10
    assert best.count() == at.select("model", "tree").distinct().count()


def test_a_draw_is_hashed_once(table):
    named = table.withColumn("scenario", F.lit("A"))
    rows = growth.prepared(named, ["a", "b", "c", "d"], SETTINGS, "scenario")
    at = growth.dealt(rows, growth.model_table(rows, SETTINGS, "scenario"), 4, SETTINGS, "scenario")
    assert at._jdf.queryExecution().optimizedPlan().toString().count("bag,") == 1
    weight = growth.bag_weight(F.col("draw"), F.col("model"), F.col("tree"), SETTINGS.seed)
    plain = at.join(rows.select("id", "draw"), "id").withColumn("again", F.when(F.col("held"), 0).otherwise(weight))
    assert plain.where("w <> again").count() == 0 < plain.where("w > 1").count()


def test_held_rows_are_noted_beside_the_way_down(table, monkeypatch):
    """By a thread of its own, whose tables a scratch block still deletes."""
    told, store = {}, growth.materialise

    def noted(df, name):
        told.setdefault(name, set()).add(threading.get_ident())
        return store(df, name)

    monkeypatch.setattr(growth, "materialise", noted)
    spark = table.sparkSession
    with session.scratch(spark):
        found = growth.grow(table.withColumn("scenario", F.lit("A")), SETTINGS)
        assert found.predictions.count() > 0
        paths = list(session._scratch.get()[-1])
    assert threading.get_ident() not in told["forest-passed"] and told["forest-nodes"] == {threading.get_ident()}
    assert any("forest-passed" in p for p in paths) and not any(session.path_exists(spark, p) for p in paths)


def test_few_rows_are_refused(table):
    with pytest.raises(ValueError):
        growth.grow_scenarios(table.where("CVEGEO = '0001'"), {"A": ("03_ola_2",)}, SETTINGS)


def test_runs_are_kept_and_read(spark, table, monkeypatch):
    asked, grow = [], growth.grow_scenarios

    def small(rows, scenarios, settings):
        asked.append(settings)
        return grow(rows, {"A": ("03_ola_2",)}, SETTINGS)

    monkeypatch.setattr(catalogue, "_features_v1", lambda *_: table)
    monkeypatch.setattr(growth, "grow_scenarios", small)
    metrics = catalogue.scenario_forest_metrics(spark, "somewhere").collect()
    assert catalogue.scenario_forest_importance(spark, "somewhere").count() == 4
    assert catalogue.scenario_models(spark, "somewhere").first()["settings"] == 25
    assert asked == [forest.ForestSettings()]
    assert (asked[0].trees, asked[0].folds, len(asked[0].grid)) == (2000, 10, 25)
    assert {r["set"] for r in metrics} == {"folds", "untuned", "test"}
    monkeypatch.setattr(catalogue, "_features_v1", lambda *_: table.withColumn("a", F.col("a") + 1))
    catalogue.scenario_forest_importance(spark, "somewhere")
    assert len(asked) == 2


def test_a_run_without_manifest_is_no_run(spark, grown, tmp_path):
    path = f"{tmp_path}/run"
    grown.importance.write.parquet(f"{path}/importance")
    assert not results.is_kept(spark, path)
    results.keep_run(grown, SETTINGS, path)
    assert results.is_kept(spark, path)
    back = results.read_run(spark, path)
    assert back.manifest.first()["trees"] == 6 and back.importance.count() == grown.importance.count()
    assert back.nodes.count() == grown.growth.nodes.count()


def test_bench_leaves_the_forests_out():
    assert all(n.startswith("scenario_") for n in bench.LEFT_OUT)
