import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinigrid.operators import grouping, joins, reshape


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; some keys are missing."""
    draw = random.Random(1)
    data = [(7 if i % 3 == 0 else draw.randrange(40) if i % 10 else None, i) for i in range(6000)]
    return spark.createDataFrame(data, "k int, v int")


def test_natural_join(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 5)], "k int, b int")
    assert rows(joins.natural_join(a, b)) == [(1, "x", 5), (2, "y", None)]
    assert rows(joins.natural_join(a, b, "inner")) == [(1, "x", 5)]
    with pytest.raises(ValueError):
        joins.natural_join(a, b.withColumnRenamed("k", "z"))


def test_suffixed_join_keeps_both_and_fans_out(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, v string")
    got = joins.suffixed_join(a, b, ["k"])
    assert got.columns == ["k", "v_x", "v_y"]
    assert got.count() == 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_safe_join_equals_plain_join(spark, rows, skewed, how):
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 40, 2)], "k int, r string")
    got = joins.skew_safe_join(skewed, right, ["k"], how, hot_rows=100)
    assert rows(got) == rows(skewed.join(right, "k", how))


def test_skew_safe_join_splits_the_hot_key(spark, skewed):
    hot = joins.find_hot_keys(skewed, ["k"], hot_rows=500)
    assert {r["k"]: r["_splits"] for r in hot.collect()}[7] >= 4
    salted = joins.salt_left(skewed, hot, ["k"], ["v"])
    largest = salted.where("k = 7").groupBy("_salt").count().agg(F.max("count")).first()[0]
    assert largest < 700
    missing = salted.where("k IS NULL").select("_salt").distinct().count()
    assert missing > 100
    assert joins.find_hot_keys(skewed, ["k"]) is None


def test_attach_has_two_ways(spark, rows, skewed):
    table = spark.createDataFrame([(i, i * 10) for i in range(40)], "k int, t int")
    small = joins.attach(skewed, table, ["k"])
    large = joins.attach(skewed, table, ["k"], max_rows=5)
    assert rows(small) == rows(large)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_complete(spark, rows):
    df = spark.createDataFrame(
        [("a", "w1", 1, None), ("a", "w2", None, 5.0), ("b", "w1", 2, 1.0)],
        "area string, ola string, n int, v double",
    )
    got = joins.complete(df, ["area"], {"ola": ["w1", "w2"], }, {"n": 0, "v": -1.0})
    assert rows(got) == [("a", "w1", 1, -1.0), ("a", "w2", 0, 5.0), ("b", "w1", 2, 1.0), ("b", "w2", 0, -1.0)]
    with pytest.raises(Exception, match="occurs twice"):
        joins.complete(df.union(df), ["area"], {"ola": ["w1"]}, {"n": 0}).collect()


def test_complete_beyond_a_row(spark, rows, monkeypatch):
    """Large domains are joined: the same cells, missing keys included."""
    df = spark.createDataFrame([("a", 1, 2.0), (None, 3, None), ("b", 2, 1.0)], "area string, n int, v double")
    small = rows(joins.complete(df, ["area"], {"n": [1, 2, 3]}, {"v": 0.0}))
    assert len(small) == 9
    monkeypatch.setattr(joins, "MAX_GRID_CELLS", 2)
    assert rows(joins.complete(df, ["area"], {"n": [1, 2, 3]}, {"v": 0.0})) == small
    with pytest.raises(Exception, match="occurs twice"):
        joins.complete(df.union(df), ["area"], {"n": [1, 2, 3]}, {"v": 0.0}).collect()


def test_attach_checks_bytes_too(spark, monkeypatch, skewed):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10)
    table = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "k int, t string")
    joined = joins.attach(skewed, table, ["k"])
    hinted = joined._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in hinted and joined.count() == skewed.count()


def test_scratch_deletes_what_it_held(spark):
    from pathlib import Path

    from clinigrid.session import materialise, scratch, shared_folder

    with scratch(spark):
        assert materialise(spark.range(3), "held").count() == 3
        assert list(Path(shared_folder(spark).removeprefix("file:")).glob("held-*"))
    assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("held-*"))


def test_top_with_ties(spark, rows):
    df = spark.createDataFrame(
        [("a", "x", 3), ("a", "y", 3), ("a", "z", 1), ("b", "x", 1), ("b", "y", None), (None, "x", 2), (None, "y", 1)],
        "g string, i string, v int",
    )
    assert rows(grouping.top_with_ties(df, ["g"], "v"), "g", "i") == [("a", "x"), ("a", "y"), (None, "x")]


def test_with_group_stats_equals_window(spark, rows, skewed):
    got = grouping.with_group_stats(
        skewed.dropna(subset=["v"]), ["k"], {"s": F.sum("v"), "m": F.avg("v")}, salt_on=["v"]
    )
    table = skewed.dropna(subset=["v"]).toPandas()
    table["k"] = table["k"].astype("object").where(table["k"].notna(), -1)
    table["s"] = table.groupby("k")["v"].transform("sum")
    want = sorted(map(tuple, table[["k", "v", "s"]].to_numpy().tolist()))
    found = [(-1 if r["k"] is None else r["k"], r["v"], r["s"]) for r in got.collect()]
    assert sorted(found) == want


def test_numbered_is_a_global_order(spark):
    values = random.Random(2).sample(range(100_000), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r["v"]: r["i"] for r in grouping.numbered(df, ["v"], "i").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values), start=1)}


def test_ordinal_code(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string")
    small = rows(grouping.ordinal_code(df, "s", "i"))
    assert small == [("a", 1), ("a", 1), ("b", 2), ("c", 3), (None, None)]
    numbers = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,)], "x double")
    assert [r["i"] for r in grouping.ordinal_code(numbers, "x", "i").orderBy("x").collect()] == [1, 2, 3]


PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_quantiles_are_exact_both_ways(spark, limit):
    draw = random.Random(3)
    # One value makes up a third of its group.
    data = [("ab"[i % 2], 5.0 if i % 3 == 0 else round(draw.lognormvariate(3, 2), 2)) for i in range(3001)]
    data += [("one", 4.0), ("a", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = grouping.quantiles(df, "x", PROBS, ["g"], percentile_rows=limit).collect()
    assert len(got) == 4 * len(PROBS)
    for g in ("a", "b", "one", None):
        values = [x for k, x in data if k == g and x is not None]
        mine = {r["prob"]: r["x"] for r in got if r["g"] == g}
        for p in PROBS:
            assert mine[p] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_quantiles_without_groups(spark, limit):
    df = spark.range(1001).selectExpr("double(id * id) AS x")
    got = {r["prob"]: r["x"] for r in grouping.quantiles(df, "x", PROBS, percentile_rows=limit).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile([float(i * i) for i in range(1001)], p))


@pytest.mark.parametrize("by", [None, "g"])
def test_binscatter(spark, by):
    draw = random.Random(4)
    data = [("ab"[i % 2], draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = grouping.binscatter(df, "x", "y", nbins=4, by=by).collect()
    for g in ("a", "b") if by else (None,):
        group = [(x, y) for k, x, y in data if g is None or k == g]
        cuts = np.quantile([x for x, _ in group], [0.25, 0.5, 0.75])
        for b in range(4):
            ys = [y for x, y in group if sum(x > c for c in cuts) == b]
            mine = next(r for r in got if r["bin"] == b and (g is None or r["g"] == g))
            assert (mine["n"], mine["mean_y"]) == (len(ys), pytest.approx(np.mean(ys)))
            assert mine["ci_high"] == pytest.approx(
                np.mean(ys) + 1.96 * np.std(ys, ddof=1) / len(ys) ** 0.5
            )


def test_binscatter_range_limits_what_is_shown(spark):
    df = spark.range(100).selectExpr("double(id) AS x", "double(id) AS y")
    shown = grouping.binscatter(df, "x", "y", 10, x_range=(0, 50))
    assert sorted(r["bin"] for r in shown.collect()) == [0, 1, 2, 3, 4]


def test_binscatter_repeated_breakpoints(spark):
    data = [(1.0, 1.0)] * 60 + [(float(i), 2.0) for i in range(2, 42)]
    got = grouping.binscatter(spark.createDataFrame(data, "x double, y double"), "x", "y", 10)
    assert sum(r["n"] for r in got.collect()) == 100


def test_cube_slice(spark, rows):
    df = spark.createDataFrame(
        [("s", 2019, 1.0), ("s", 2020, 2.0), ("s", 2020, 3.0), ("t", 2021, 4.0)],
        "state string, year int, total double",
    )
    got = grouping.cube_slice(df, ["state", "year"], ["total"], {"year": [2019, 2020]})
    assert rows(got) == [("s", 2019, 1.0), ("s", 2020, 5.0)]


def test_wide_and_long_are_inverse(spark, rows):
    df = spark.createDataFrame(
        [("a", "x", 1.0, 2.0), ("a", "y", 3.0, None), ("b", "x", 5.0, 6.0)],
        "id string, k string, u double, v double",
    )
    wide = reshape.to_wide(df, ["id"], "k", ["x", "y"], ["u", "v"])
    assert wide.columns == ["id", "u_x", "u_y", "v_x", "v_y"]
    assert rows(wide) == [("a", 1.0, 3.0, 2.0, None), ("b", 5.0, None, 6.0, None)]
    long = reshape.to_long(wide, ["id"], ["u_x", "u_y", "v_x", "v_y"], "name", "value")
    assert rows(long.dropna()) == [
        ("a", "u_x", 1.0), ("a", "u_y", 3.0), ("a", "v_x", 2.0), ("b", "u_x", 5.0), ("b", "v_x", 6.0),
    ]


def test_wide_prefix_and_repeats(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "id string, k string, v double")
    with pytest.raises(Exception, match="two rows for one cell"):
        reshape.to_wide(df, ["id"], "k", ["x"], ["v"]).collect()
    named = reshape.to_wide(df.limit(1), ["id"], "k", ["x"], ["v"], prefix="pc_")
    assert named.columns == ["id", "pc_x"]


def test_stack_named(spark, rows):
    a = spark.createDataFrame([(1,)], "v int")
    b = spark.createDataFrame([(2, 3)], "v int, w int")
    assert rows(reshape.stack_named({"a": a, "b": b}, "t"), "t", "v", "w") == [("a", 1, None), ("b", 2, 3)]


@pytest.mark.parametrize("days", [1, 7, 400])
def test_interval_join_against_all_pairs(spark, rows, days):
    from datetime import date, timedelta

    from clinigrid.operators.joins import interval_join

    draw = random.Random(days)
    start = date(1969, 12, 20)
    points = [(i, None if i % 9 == 0 else start + timedelta(draw.randint(0, 60))) for i in range(60)]
    intervals = [
        (k, None if draw.random() < 0.2 else start + timedelta(draw.randint(-20, 70)),
         None if draw.random() < 0.2 else start + timedelta(draw.randint(-20, 70))) for k in range(25)
    ]
    a = spark.createDataFrame(points, "i int, day date")
    b = spark.createDataFrame(intervals, "k int, first date, last date")
    pairs = [(i, k) for i, d in points for k, f, t in intervals if d and (f is None or d >= f) and (t is None or d <= t)]
    assert rows(interval_join(a, b, "day", "first", "last", days), "i", "k") == sorted(pairs, key=lambda r: [(False, str(v)) for v in r])
    kept = rows(interval_join(a, b, "day", "first", "last", days, how="left"), "i", "k")
    alone = [(i, None) for i, _ in points if i not in {p for p, _ in pairs}]
    assert sorted(map(str, kept)) == sorted(map(str, pairs + alone)) and alone


def test_interval_join_has_no_product(spark):
    from clinigrid.operators.joins import interval_join

    a = spark.range(10).selectExpr("id", "date_add(date'2020-01-01', cast(id AS int)) AS day")
    b = spark.range(5).selectExpr("id AS k", "date_add(date'2020-01-01', cast(id AS int)) AS first", "cast(null AS date) AS last")
    found = interval_join(a, b, "day", "first", "last")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(a.limit(0), b, "day", "first", "last").count() == 0


def test_scratch_holds_paths_too_and_threads_apart(spark):
    from pathlib import Path
    from threading import Thread

    from clinigrid.session import materialise, new_path, scratch

    kept = []
    with scratch(spark):
        inside = Path(new_path(spark, "files").removeprefix("file:"))
        spark.range(3).selectExpr("cast(id AS string) AS v").write.text(str(inside))

        def other():
            kept.append(materialise(spark.range(5), "others"))

        thread = Thread(target=other)
        thread.start()
        thread.join()
        assert inside.exists()
    assert not inside.exists()
    assert kept[0].count() == 5
