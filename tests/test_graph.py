import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinigrid.operators import graph, joins


def square(geo, x, y, size=1.0):
    return [(geo, 0, 0, i, x + dx * size, y + dy * size)
            for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]


@pytest.fixture(scope="module")
def layer(spark):
    """a-b share a side, a-c one corner, d is an island."""
    data = square("a", 0, 0) + square("b", 1, 0) + square("c", 1, 1) + square("d", 9, 9)
    return spark.createDataFrame(data, "geo_id string, part int, ring int, seq int, x double, y double")


def test_queen_needs_one_common_point(rows, layer):
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    want = sorted(pairs + [(y, x) for x, y in pairs])
    assert rows(graph.contiguity(layer)) == want


def test_rook_needs_a_common_side(rows, layer):
    assert rows(graph.contiguity(layer, "rook")) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    with pytest.raises(ValueError):
        graph.contiguity(layer, "rook", tolerance=1.0)


def test_tolerance_reaches_over_cell_borders(spark, rows):
    data = square("a", 0, 0) + square("b", 1.004, 0) + square("c", 3, 0)
    layer = spark.createDataFrame(data, "geo_id string, part int, ring int, seq int, x double, y double")
    assert rows(graph.contiguity(layer)) == []
    assert rows(graph.contiguity(layer, tolerance=0.01)) == [("a", "b"), ("b", "a")]


def test_contiguity_of_a_point_where_many_areas_meet(spark):
    """Slices of a disc all touch in its centre: every pair is adjacent."""
    n = 40
    data = []
    for i in range(n):
        a, b = (2 * math.pi * k / n for k in (i, i + 1))
        for seq, (x, y) in enumerate(((0, 0), (math.cos(a), math.sin(a)), (math.cos(b), math.sin(b)))):
            data.append((i, 0, 0, seq, float(x), float(y)))
    layer = spark.createDataFrame(data, "geo_id int, part int, ring int, seq int, x double, y double")
    assert graph.contiguity(layer).count() == n * (n - 1)


def test_edges_from_lists(spark, rows):
    df = spark.createDataFrame([("a", ["b", "c"]), ("d", [])], "area string, n array<string>")
    assert rows(graph.edges_from_lists(df, "area", "n")) == [("a", "b"), ("a", "c")]


def test_simple_graph_merges_and_drops_loops(spark, rows):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 9.0)], "V1 string, V2 string, weight double")
    assert rows(graph.simple_graph(df)) == [("a", "b", 3.0)]


@pytest.mark.parametrize("hot_rows", [1, 2_000_000])
def test_neighbour_sums(spark, rows, monkeypatch, hot_rows):
    monkeypatch.setattr(joins.skew_safe_join, "__defaults__", ("inner", None, hot_rows, None, None))
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "x")], "V1 string, V2 string")
    attributes = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, None), ("c", 3.0, 7)], "k string, u double, v int")
    assert rows(graph.neighbour_sums(edges, attributes, "k")) == [
        ("a", 5.0, None), ("b", 1.0, 5), ("c", None, None),
    ]


@pytest.mark.parametrize("width", [None, 5])
def test_cosine_edges(spark, width):
    draw = random.Random(5)
    vectors = {i: [draw.gauss(0, 1) for _ in range(5)] for i in range(6)} | {6: [0.0] * 5, 7: [1.0, None, 1.0, 1.0, 1.0]}
    pairs = list(itertools.permutations(range(8), 2))
    edges = spark.createDataFrame(pairs, "V1 int, V2 int")
    table = spark.createDataFrame(list(vectors.items()), "id int, f array<double>")
    got = {(r[0], r[1]): r[2] for r in graph.cosine_edges(edges, table, "id", "f", width).collect()}
    assert len(got) == len(pairs)
    for a, b in pairs:
        if max(a, b) > 5:
            assert got[a, b] is None
        else:
            u, v = np.array(vectors[a]), np.array(vectors[b])
            assert got[a, b] == pytest.approx(1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v))
            assert got[a, b] == got[b, a]


def two_cliques():
    pairs = list(itertools.combinations("abcdef", 2)) + list(itertools.combinations("uvwxyz", 2))
    return [(a, b, 1.0) for a, b in pairs] + [("f", "u", 0.1)]


@pytest.fixture(scope="module")
def cliques(spark):
    return spark.createDataFrame(two_cliques(), "src string, dst string, weight double")


@pytest.mark.parametrize("seed", [1, 725])
def test_two_cliques_are_two_communities(rows, cliques, seed):
    got = graph.communities(cliques, trials=2, seed=seed)
    assert rows(got) == [(c, 1, 6) for c in "abcdef"] + [(c, 2, 6) for c in "uvwxyz"]


@pytest.mark.parametrize("edges", [
    [("a", "b", 1.0)], [(a, b, 1.0) for a in "abc" for b in "xyz"],
])
def test_propagation_settles_where_a_synchronous_rule_oscillates(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    labels = graph.propagate_labels(df)
    assert labels.select("label").distinct().count() == 1


def votes_by_hand(edges, labels, keep_current):
    out = {}
    for v in labels:
        score = {}
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == v:
                    score[labels[y]] = score.get(labels[y], 0) + round(w / 1e-9)
        best = max(score.values())
        tied = sorted(k for k, s in score.items() if s == best)
        out[v] = labels[v] if keep_current and labels[v] in tied else tied[0]
    return out


@pytest.mark.parametrize("keep_current", [True, False])
@pytest.mark.parametrize("hot_rows", [3, None])
def test_label_round_against_brute_force(spark, keep_current, hot_rows):
    draw = random.Random(6)
    edges = {(a, b): draw.choice([0.5, 1.0, 2.0]) for a, b in itertools.combinations(range(30), 2) if a == 0 or draw.random() < 0.1}
    edges = [(a, b, w) for (a, b), w in edges.items()]
    labels = {v: draw.randrange(5) for v in range(30)}
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    ends = graph._weighted_ends(df)
    hot = None
    if hot_rows:
        hot = joins.hot_keys(ends, ["u"], hot_rows)
        ends = joins.salt_left(ends, hot, ["u"], ["v"])
    state = spark.createDataFrame([(0, k, v) for k, v in labels.items()], "trial int, id int, label int")
    got = {r["id"]: r["wanted"] for r in graph.label_round(ends, state, hot, keep_current).collect()}
    assert got == votes_by_hand(edges, labels, keep_current)


def quality_by_hand(edges, labels):
    total = 2 * sum(w for *_, w in edges)
    strength, cut, inside = {}, {}, {}
    for a, b, w in edges:
        for v in (a, b):
            strength[v] = strength.get(v, 0) + w
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0) + w
        else:
            for v in (a, b):
                cut[labels[v]] = cut.get(labels[v], 0) + w
    groups = set(labels.values())
    p = {c: sum(s for v, s in strength.items() if labels[v] == c) / total for c in groups}
    q = {c: cut.get(c, 0) / total for c in groups}
    plogp = lambda x: x * math.log2(x) if x > 0 else 0.0
    modularity = sum(2 * inside.get(c, 0) / total - p[c] ** 2 for c in groups)
    length = (
        plogp(sum(q.values())) - 2 * sum(map(plogp, q.values()))
        - sum(plogp(s / total) for s in strength.values()) + sum(plogp(q[c] + p[c]) for c in groups)
    )
    return len(groups), modularity, length


@pytest.mark.parametrize("split", ["abcdef", "abc", ""])
def test_partition_quality(spark, cliques, split):
    labels = {v: int(v in split) for v in "abcdefuvwxyz"}
    table = spark.createDataFrame(list(labels.items()), "id string, label int")
    got = graph.partition_quality(cliques, table).first()
    assert tuple(got) == pytest.approx(quality_by_hand(two_cliques(), labels))


def test_the_right_partition_has_the_shortest_code(spark, cliques):
    data = [(0, v, int(v in "abcdef")) for v in "abcdefuvwxyz"] + [(1, v, int(v in "abc")) for v in "abcdefuvwxyz"]
    table = spark.createDataFrame(data, "trial int, id string, label int")
    got = {r["trial"]: r["codelength"] for r in graph.partition_quality(cliques, table, ["trial"]).collect()}
    assert got[0] < got[1]


def test_fixed_rounds(spark, rows):
    df = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    assert rows(graph.propagate_labels_fixed(df, 1)) == [("a", "b"), ("b", "a"), ("c", "b")]


def test_only_the_last_round_stays_stored(spark, cliques):
    from pathlib import Path

    from clinigrid.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("labels-*"))
    labels = graph.propagate_labels(cliques)
    assert labels.count() == 12
    assert len(set(folder.glob("labels-*")) - before) == 1


def test_a_limit_that_comes_too_early_is_an_error(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "src int, dst int, weight double")
    with pytest.raises(graph.NotSettled):
        graph.propagate_labels(path, max_iter=1)
    settled = graph.propagate_labels(path)
    assert graph.unsettled(path, settled.select("id", "label")).count() == 0


def test_large_weights_do_not_overflow(spark, cliques):
    heavy = cliques.withColumn("weight", F.col("weight") * 1e12)
    want = {tuple(r) for r in graph.propagate_labels(cliques).collect()}
    assert {tuple(r) for r in graph.propagate_labels(heavy).collect()} == want


def test_a_vector_of_another_width_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b")], "V1 string, V2 string")
    table = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 1.0]), ("b", [1.0, 0.0, 0.0, 9.0])], "id string, f array<double>")
    with pytest.raises(Exception, match="not 3 wide"):
        graph.cosine_edges(edges, table, "id", "f", 3).collect()


def test_missing_weights_take_no_part(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", None)], "src string, dst string, weight double")
    labels = {r["id"]: r["label"] for r in graph.propagate_labels(df).collect()}
    assert labels["a"] == labels["b"] != labels["c"]
    assert graph._weighted_ends(df).where(F.col("v") == "c").count() == 0


def random_graph(seed, vertices=60, share=0.08):
    draw = random.Random(seed)
    return [(a, b, draw.choice([0.5, 1.0, 1.0, 2.0, draw.random()])) for a, b in itertools.combinations(range(vertices), 2)
            if draw.random() < share]


def test_runs_start_along_heaviest_edges(spark):
    edges = random_graph(1)
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    ends = graph._weighted_ends(df)
    got = {}
    for r in graph.heaviest_start(ends, 3).collect():
        got.setdefault(r["trial"], {})[r["id"]] = r["label"]
    assert set(got) == {0, 1, 2} and got[1] != got[2]
    for labels in got.values():
        # A label is a member's, and no vertex is alone that has a neighbour.
        assert all(labels[label] == label for label in labels.values())
        assert all(list(labels.values()).count(label) > 1 for label in set(labels.values()))
    best = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            best.setdefault(x, []).append((w, y))
    for v, near in best.items():
        top = max(w for w, _ in near)
        heaviest = [u for w, u in near if w == top]
        assert any(got[0][u] == got[0][v] for u in heaviest)


@pytest.mark.parametrize("seed", [2, 3])
def test_frontier_runs_end_settled(spark, seed):
    df = spark.createDataFrame(random_graph(seed), "src int, dst int, weight double")
    labels = graph.settled_labels(df, trials=4, seed=seed)
    assert labels.count() == labels.select("trial", "id").distinct().count() == 4 * len({v for e in random_graph(seed) for v in e[:2]})
    for trial in range(4):
        assert graph.unsettled(df, labels.where(F.col("trial") == trial).select("id", "label")).count() == 0


def test_late_rounds_look_at_fewer_rows(spark, monkeypatch):
    """Many cliques that settle at once, and one path that does not."""
    edges = [(10 * c + a, 10 * c + b, 1.0) for c in range(40) for a, b in itertools.combinations(range(5), 2)]
    edges += [(1000 + i, 1001 + i, 1.0 + (i % 7) / 10) for i in range(80)] + [(1000 + i, 1002 + i, 1.5) for i in range(80)]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    asked, wanted = [], graph._wanted

    def counted(votes, keep_current):
        asked.append(votes.count())
        return wanted(votes, keep_current)

    monkeypatch.setattr(graph, "_wanted", counted)
    labels = graph.settled_labels(df, trials=2)
    assert len(asked) > 5 and asked[4] < asked[0] / 4 and asked[-1] < asked[0] / 10
    monkeypatch.undo()
    for trial in range(2):
        assert graph.unsettled(df, labels.where(F.col("trial") == trial).select("id", "label")).count() == 0


def test_vertices_without_weights_are_communities_of_their_own(spark, rows):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", None)], "src string, dst string, weight double")
    assert rows(graph.communities(df, trials=2)) == [("a", 1, 2), ("b", 1, 2), ("c", 2, 1)]


def test_a_limit_before_the_frontier_is_empty_is_an_error(spark):
    df = spark.createDataFrame(random_graph(4, 80, 0.2), "src int, dst int, weight double")
    with pytest.raises(graph.NotSettled):
        graph.settled_labels(df, max_iter=1)


def test_plain_weights_where_they_hold(spark):
    """Labels are the same with plain weights as with the wide ones that large weights keep."""
    edges = [(a, b, draw) for a, b, draw in random_graph(5) if draw in (0.5, 1.0, 2.0)]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    heavy = df.withColumn("weight", F.col("weight") * 1e12)
    kinds = [graph._plain_weights(graph._weighted_ends(g)).schema["w"].dataType.simpleString() for g in (df, heavy)]
    assert kinds == ["bigint", graph.WEIGHT_TYPE]
    found = [{tuple(r) for r in graph.settled_labels(g, trials=2).collect()} for g in (df, heavy)]
    assert found[0] == found[1]


def test_the_start_is_dealt_to_tasks_by_its_drawn_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_TASK", 100)
    ends = graph._weighted_ends(spark.createDataFrame(random_graph(1), "src int, dst int, weight double").coalesce(1))
    plans, write = [], graph.write_stage

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "write_stage", seen)
    graph.heaviest_start(ends, 3)
    assert f", {-(-ends.count() * 3 // 100)}" in next(x for x in plans[0].splitlines() if "RepartitionByExpression" in x)


def test_blocks_of_any_size_find_the_same(spark, monkeypatch):
    """A vertex whose ends lie in many blocks, and repeated ends, beside one block for all."""
    edges = random_graph(6, 40, 0.1) + [(-1, v, 1.0) for v in range(40)]
    df = spark.createDataFrame(edges + edges[:3], "src int, dst int, weight double")
    found = []
    for size in (1_000_000, 20):
        monkeypatch.setattr(graph, "VOTES_A_BLOCK", size)
        found.append({tuple(r) for r in graph.settled_labels(df, trials=2).collect()})
    assert found[0] == found[1] and len(found[0]) == 2 * 41


def test_only_votes_that_can_change_a_label_leave_the_tasks(spark, monkeypatch):
    edges = random_graph(7, 60, 0.3)
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    asked, wanted = [], graph._wanted

    def counted(votes, keep_current):
        asked.append(votes.count())
        return wanted(votes, keep_current)

    monkeypatch.setattr(graph, "_wanted", counted)
    with pytest.raises(graph.NotSettled):
        graph.settled_labels(df, trials=2, max_iter=1)
    # At most the label that wins and its own, of 60 vertices in 2 trials.
    assert 0 < asked[0] <= 2 * 60 * 2 < len(edges)
