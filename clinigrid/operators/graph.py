"""Area adjacency, neighbour sums, vertex similarity, communities and their quality."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from clinigrid.functions import numeric_columns
from clinigrid.operators import ballots
from clinigrid.operators.grouping import numbered
from clinigrid.operators.joins import find_hot_keys, salt_left, salt_right, skew_safe_join
from clinigrid.session import drop_stage, literal_table, materialise, write_stage

# Edge weights are added as whole numbers of this unit, so that the order in which tasks
# add them cannot change which label wins.
WEIGHT_UNIT = 1e-9
# Holds weights to 1e19, and sums of 1e10 of them.
WEIGHT_TYPE = "decimal(28,0)"
# Fixed value: runs of which the best is kept.
TRIALS = 100
# Drawn edges that a task of the start gets, about, and weights of a vertex that plain whole numbers hold.
EDGES_A_TASK = 1_000_000
PLAIN_WEIGHT = 1 << 62
# Votes of all trials that a block of the search gets, about.
VOTES_A_BLOCK = 1_000_000
# Every so many rounds the blocks store their labels anew, with the news since.
RENEWED = 5
# Every so many rounds a smaller share of the vertices moves at once.
PATIENCE = 25


# --- adjacency ----------------------------------------------------------------------

def both_directions(pairs: DataFrame) -> DataFrame:
    """Rows (V1, V2) and (V2, V1) of every unordered pair."""
    ways = F.array(
        F.struct(F.col("V1"), F.col("V2")),
        F.struct(F.col("V2").alias("V1"), F.col("V1").alias("V2")),
    )
    return pairs.select(F.inline(ways))


def _pairs_sharing(items: DataFrame, on: list[str]) -> DataFrame:
    """Unordered pairs of different geo_id that share a value of ``on``.

    Both sides are the same plain shuffle, which runs once and which adaptive execution
    may split when very many areas meet in one place.
    """
    a = items.withColumnRenamed("geo_id", "V1")
    b = items.withColumnRenamed("geo_id", "V2")
    return a.join(b, on).where(F.col("V1") < F.col("V2")).select("V1", "V2").distinct()


def contiguity(vertices: DataFrame, rule: str = "queen", tolerance: float = 0.0) -> DataFrame:
    """Directed pairs (V1, V2) of polygons that touch; an island has no row.

    ``queen``: one common boundary point is enough, up to ``tolerance`` apart.
    ``rook``: a common boundary segment is needed; coordinates must match exactly.
    ``vertices``: geo_id, part, ring, seq, x, y.
    """
    if rule == "rook":
        if tolerance:
            raise ValueError("the rook rule takes exactly matching coordinates")
        return both_directions(_pairs_sharing(segments(vertices), ["px", "py", "qx", "qy"]))
    if rule != "queen":
        raise ValueError(f"unknown rule {rule!r}")
    points = vertices.select("geo_id", "x", "y").distinct()
    if not tolerance:
        return both_directions(_pairs_sharing(points, ["x", "y"]))
    return both_directions(_near_pairs(points, tolerance))


def _near_pairs(points: DataFrame, tolerance: float) -> DataFrame:
    """Pairs with points at most ``tolerance`` apart: probe the 9 grid cells around."""
    cell = [F.floor(F.col(c) / tolerance).alias(f"c{c}") for c in ("x", "y")]
    near = F.sequence(F.lit(-1), F.lit(1))
    left = points.select(F.col("geo_id").alias("V1"), "x", "y", *cell)
    right = (
        points.select(F.col("geo_id").alias("V2"), F.col("x").alias("x2"), F.col("y").alias("y2"), *cell)
        .withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
        .select("V2", "x2", "y2", (F.col("cx") + F.col("dx")).alias("cx"),
                (F.col("cy") + F.col("dy")).alias("cy"))
    )
    distance = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return (
        left.join(right, ["cx", "cy"])
        .where((F.col("V1") < F.col("V2")) & (distance <= tolerance))
        .select("V1", "V2").distinct()
    )


def segments(vertices: DataFrame) -> DataFrame:
    """Undirected boundary segments of every ring, the closing one included.

    Columns: geo_id, px, py, qx, qy, with the smaller end point first.
    """
    # A window holds one ring, which is a polygon's at most; its last point goes back to the first.
    ring = Window.partitionBy("geo_id", "part", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("x", "y")
    sides = vertices.select(
        "geo_id", point.alias("a"), F.coalesce(F.lead(point).over(ring), F.first(point).over(whole)).alias("b")
    )
    return (
        sides.where(F.col("a") != F.col("b"))
        .select("geo_id", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
        .selectExpr("geo_id", "p.x AS px", "p.y AS py", "q.x AS qx", "q.y AS qy")
        .distinct()
    )


def edges_from_lists(df: DataFrame, area: str, neighbours: str) -> DataFrame:
    """Edge rows (V1, V2) from one neighbour array per area."""
    return df.select(F.col(area).alias("V1"), F.explode(neighbours).alias("V2"))


def simple_graph(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Undirected simple graph: loops dropped, parallel edges merged by adding weights."""
    return (
        edges.where(F.col("V1") != F.col("V2"))
        .groupBy(F.least("V1", "V2").alias("src"), F.greatest("V1", "V2").alias("dst"))
        .agg(F.sum(weight).alias("weight"))
    )


def neighbour_sums(
    edges: DataFrame, attributes: DataFrame, key: str, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """Sum of every numeric attribute over an area's neighbours, the area itself left out.

    A neighbour without attributes makes the sum missing. ``extra_keys`` keeps the sums
    apart by further attribute columns.
    """
    values = numeric_columns(attributes, exclude=[key, *extra_keys])
    other = attributes.withColumnRenamed(key, "V2")
    joined = skew_safe_join(edges.select("V1", "V2"), other, ["V2"], "left", salt_on=["V1"])
    sums = [f"CASE WHEN count(`{v}`) = count(1) THEN sum(`{v}`) END AS `{v}`" for v in values]
    return (
        joined.groupBy("V1", *extra_keys).agg(*map(F.expr, sums)).withColumnRenamed("V1", key)
    )


# --- similarity ---------------------------------------------------------------------

def dot(a: str, b: str, width: int | None = None) -> Column:
    """Inner product of two array columns; a known width unrolls into compiled code.

    A vector of another width is an error, not cut.
    """
    if width:
        product = " + ".join(f"get(`{a}`, {i}) * get(`{b}`, {i})" for i in range(width))
        return F.expr(
            f"CASE WHEN size(`{a}`) <> {width} OR size(`{b}`) <> {width} "
            f"THEN raise_error('a vector is not {width} wide') ELSE {product} END"
        )
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine_edges(
    edges: DataFrame, vectors: DataFrame, key: str, features: str, width: int | None = None
) -> DataFrame:
    """Cosine distance of the two ends of each edge: ``V1, V2, cosine_distance``.

    Only pairs that are edges are computed. A missing coordinate or a zero vector gives a
    missing distance. ``edges`` is read several times; pass it stored.
    """
    sized = vectors.select(key, features, F.sqrt(dot(features, features, width)).alias("_norm"))
    ends = edges.select("V1", "V2")
    for end, other in (("V1", "V2"), ("V2", "V1")):
        side = sized.select(
            F.col(key).alias(end), F.col(features).alias(f"_f{end}"), F.col("_norm").alias(f"_n{end}")
        )
        ends = skew_safe_join(ends, side, [end], "left", salt_on=[other], counted_on=edges)
    cosine = F.try_divide(dot("_fV1", "_fV2", width), F.col("_nV1") * F.col("_nV2"))
    return ends.select("V1", "V2", (1 - cosine).alias("cosine_distance"))


# --- communities --------------------------------------------------------------------

def _weighted_ends(graph: DataFrame) -> DataFrame:
    """Both ends of every edge with a whole-number weight: (v, u, w)."""
    w = F.round(F.col("weight") / WEIGHT_UNIT).cast(WEIGHT_TYPE)
    ends = F.array(
        F.struct(F.col("src").alias("v"), F.col("dst").alias("u"), w.alias("w")),
        F.struct(F.col("dst").alias("v"), F.col("src").alias("u"), w.alias("w")),
    )
    return graph.where(F.col("weight").isNotNull()).select(F.inline(ends))


def _plain_weights(ends: DataFrame) -> DataFrame:
    """``ends`` with weights as plain whole numbers, unless a vertex has more weight than those hold."""
    most = ends.groupBy("v").agg(F.sum("w").alias("w")).agg(F.max("w")).first()[0]
    held = most is None or most < PLAIN_WEIGHT
    return ends.withColumn("w", F.col("w").cast("bigint")) if held else ends


def label_round(
    ends: DataFrame, labels: DataFrame, hot: DataFrame | None, keep_current: bool
) -> DataFrame:
    """Label each vertex wants: the one its neighbours carry with the most weight.

    Ties go to the current label if ``keep_current`` and it is among the best, else to the
    smallest label. ``labels``: trial, id, label; ``ends`` is salted if ``hot`` is given.
    Scores combine before each shuffle, so a vertex with very many edges is no single-task
    group.
    """
    carried = labels.withColumnRenamed("id", "u")
    if hot is None:
        joined = ends.join(carried, "u")
    else:
        joined = ends.join(salt_right(carried, hot, ["u"]), ["u", "_salt"])
    votes = joined.selectExpr("trial", "v AS id", "label", "w", "0 AS own")
    # Each vertex adds its own label without weight, which brings it to the comparison.
    current = labels.selectExpr("trial", "id", "label", f"CAST(0 AS {WEIGHT_TYPE}) AS w", "1 AS own")
    return _wanted(votes.unionByName(current), keep_current)


def _wanted(votes: DataFrame, keep_current: bool) -> DataFrame:
    """(trial, id, label, wanted) from votes (trial, id, label, w, own)."""
    scores = votes.groupBy("trial", "id", "label").agg(
        F.expr("sum(w) AS score"), F.expr("max(own) AS own"), F.expr("count_if(own = 0) AS votes")
    )
    preferred = "-own" if keep_current else "0"
    return scores.groupBy("trial", "id").agg(
        F.expr("max(CASE WHEN own = 1 THEN label END) AS label"),
        F.expr(
            f"min(CASE WHEN votes > 0 THEN struct(-score, {preferred}, label) END).label AS wanted"
        ),
    ).withColumn("wanted", F.coalesce("wanted", "label"))


def _partitioned_ends(graph: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edge ends, laid out once by the vertex whose label they carry (and its salts).

    Every round then moves only labels to the edges and votes away from them. The layout is
    cached over a written table: what a lost executor held is read and laid out again.
    """
    ends = materialise(_weighted_ends(graph), "ends")
    hot = find_hot_keys(ends, ["u"])
    keys = ["u"]
    if hot is not None:
        ends, keys = salt_left(ends, hot, ["u"], ["v"]), ["u", "_salt"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = ends.repartition(parts, *keys).sortWithinPartitions(*keys)
    return laid_out.persist(StorageLevel.MEMORY_AND_DISK), hot


def _initial_labels(graph: DataFrame, trials: int) -> DataFrame:
    ids = graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.select(
        F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "id",
        F.col("id").alias("label"),
    )


class NotSettled(RuntimeError):
    """The caller's limit of rounds came before every vertex had the label it wants."""


def _rounds(graph: DataFrame, trials: int, limit: int | None, step: Callable) -> tuple[DataFrame, int]:
    """Labels after rounds of ``step(ends, labels, hot, round)``, and how many are unsettled.

    Each round is one job and is written out, so a lost executor costs at most one round and
    the plan stays short; the round before is deleted then. A round in which no label is
    left ``unsettled`` is the last, or the one at the limit.
    """
    spark = graph.sparkSession
    ends, hot = _partitioned_ends(graph)
    labels, path = _initial_labels(graph, trials), None
    try:
        left = 1
        for i in count() if limit is None else range(limit):
            seen = Observation()
            moved = step(ends, labels, hot, i).observe(
                seen, F.count_if("unsettled").alias("unsettled")
            )
            before = path
            stored, path = write_stage(moved, "labels")
            labels = stored.drop("unsettled")
            drop_stage(spark, before)
            left = seen.get["unsettled"]
            if left == 0:
                break
    finally:
        ends.unpersist()
    return labels, left


def propagate_labels_fixed(graph: DataFrame, rounds: int) -> DataFrame:
    """Label propagation, all vertices at once, smallest label on ties, a fixed round count."""
    def step(ends, labels, hot, number):
        wanted = label_round(ends, labels, hot, keep_current=False)
        return wanted.selectExpr("trial", "id", "wanted AS label", "true AS unsettled")

    return _rounds(graph, 1, rounds, step)[0].drop("trial")


def propagate_labels(
    graph: DataFrame, trials: int = 1, max_iter: int | None = None, seed: int = 725
) -> DataFrame:
    """Semi-synchronous weighted label propagation: (trial, id, label).

    Each round a hashed share of the vertices takes the label it wants; the run ends when
    no vertex wants another one. A vertex that moves alone adds weight inside the groups,
    of which there is a finite amount; neighbours that move at once may undo that, so the
    share shrinks from a half as rounds go by, which brings every run to an end. All trials
    share every round's job. With ``max_iter``, a run that is not over by then is an error.
    """
    def step(ends, labels, hot, number):
        share = F.lit(2 + number // PATIENCE)
        turn = F.pmod(F.xxhash64("id", "trial", F.lit(number), F.lit(seed)), share) == 0
        return label_round(ends, labels, hot, keep_current=True).select(
            "trial", "id",
            F.when(turn, F.col("wanted")).otherwise(F.col("label")).alias("label"),
            (F.col("wanted") != F.col("label")).alias("unsettled"),
        )

    labels, left = _rounds(graph, trials, max_iter, step)
    if left and max_iter is not None:
        raise NotSettled(f"{left} labels not settled after {max_iter} rounds")
    return labels


def heaviest_start(ends: DataFrame, trials: int, seed: int = 725) -> DataFrame:
    """(trial, id, label): vertices share a label along the heaviest edge of each; ``ends`` is stored.

    In trial 0 edges weigh what they weigh, in others each is drawn between half and one
    and a half of that, so that trials start apart. Edges have one strict order, the same
    from both ends, so following heaviest edges ends in a pair that chose each other; the
    smaller of the two lends its label. Paths are halved in every round.
    """
    spark = ends.sparkSession
    drawn = [F.xxhash64(F.lit(seed), F.lit(t), F.least("v", "u"), F.greatest("v", "u")) for t in range(trials)]
    # A small table becomes many rows, so it is dealt to tasks first, in the order of v, which may fill several.
    parts = max(1, -(-ends.count() * trials // EDGES_A_TASK))
    dealt = ends.repartitionByRange(parts, "v", "u").sortWithinPartitions("v", "u")
    key = ends.schema["v"].dataType.simpleString()
    # Of one vertex, edges are in the order of their other ends.
    chosen = dealt.select("v", "u", F.col("w").cast("double").alias("w"), F.array(*drawn).alias("drawn")).mapInArrow(
        ballots.heaviest, f"trial int, id {key}, score double, drawn double, next {key}"
    ).groupBy("trial", "id").agg(F.max(F.struct("score", "drawn", "next")).alias("e")).select("trial", "id", F.col("e.next").alias("next"))
    chosen, held = write_stage(chosen, "start")
    back = chosen.select("trial", F.col("id").alias("next"), F.col("next").alias("theirs"))
    # Of two that chose each other the smaller points to itself.
    first = (F.col("theirs") == F.col("id")) & (F.col("id") < F.col("next"))
    current, path = write_stage(chosen.join(back, ["trial", "next"]).select(
        "trial", "id", F.when(first, F.col("id")).otherwise(F.col("next")).alias("next")
    ), "start")
    drop_stage(spark, held)
    while True:
        ahead = current.select("trial", F.col("id").alias("next"), F.col("next").alias("further"))
        seen = Observation()
        joined = current.join(ahead, ["trial", "next"]).select("trial", "id", F.col("further").alias("next"), F.col("next").alias("was"))
        moved, fresh = write_stage(
            joined.observe(seen, F.count_if(F.col("next") != F.col("was")).alias("moved")).drop("was"), "start"
        )
        drop_stage(spark, path)
        current, path = moved, fresh
        if seen.get["moved"] == 0:
            return current.withColumnRenamed("next", "label")


def _dealt_ends(ends: DataFrame, ids: DataFrame, trials: int) -> tuple[DataFrame, DataFrame]:
    """Ends (block, v, u, w, home, last) with numbered vertices, and which blocks a vertex meets: (id, key, block).

    Blocks are equal runs of all ends in the order of v, so a vertex of any degree is dealt
    to as many as it fills, ``home`` to ``last``.
    """
    for end in ("v", "u"):
        ends = ends.withColumnRenamed(end, "key").join(ids, "key").withColumnRenamed("id", end).drop("key")
    size = max(1, VOTES_A_BLOCK // trials)
    dealt = materialise(numbered(ends, ["v", "u"], "at").withColumn("block", F.floor((F.col("at") - 1) / size)).drop("at"), "dealt")
    spans = dealt.groupBy("v").agg(F.min("block").alias("home"), F.max("block").alias("last"))
    met = dealt.select("block", F.explode(F.array("v", "u")).alias("id")).distinct()
    return dealt.join(spans, "v"), materialise(met.join(ids, "id"), "met")


def _by_block(stored: DataFrame, rows: DataFrame, task: Callable, schema, *args: int) -> DataFrame:
    """``task`` over each block and the rows that are for it."""
    def run(one: pa.Table, given: pa.Table) -> pa.Table:
        return task(one, given, *args)

    return stored.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)


def settled_labels(
    graph: DataFrame, trials: int = 1, max_iter: int | None = None, seed: int = 725
) -> DataFrame:
    """Label propagation from the heaviest edges on until no vertex wants another label: (trial, id, label).

    A round looks at the frontier only: vertices that wanted another label or have a
    neighbour that did. All others have the votes they had. Of neighbours that want
    another label the first by a hash of the round moves; as no two neighbours move at
    once, every move adds weight inside the groups, of which there is a finite amount. A
    round is one job: blocks of ends hold the labels they meet and count for all trials at
    once (``ballots``), and only votes that can change a label, wishes and moves leave them.
    """
    spark = graph.sparkSession
    ends = _plain_weights(materialise(_weighted_ends(graph), "ends"))
    kind = ends.schema["w"].dataType.simpleString()
    ids = materialise(numbered(ends.select(F.col("v").alias("key")).distinct(), ["key"], "id"), "ids")
    # Vertices of no known weight keep their own label.
    alone = _initial_labels(graph, trials).join(ids.select(F.col("key").alias("id")), "id", "left_anti")
    dealt, met = _dealt_ends(ends, ids, trials)
    numbers = [ids.select(F.col("key").alias(c), F.col("id").alias(f"_{c}")) for c in ("id", "label")]
    start = heaviest_start(ends, trials, seed).join(numbers[0], "id").join(numbers[1], "label").select(
        "trial", F.col("_id").alias("id"), F.col("_label").alias("label")
    )
    frame = ballots.FRAME.format(kind=kind)
    stored, held = write_stage(
        _by_block(dealt, start.join(met, "id").drop("key"), ballots.opened, f"{frame}, labels binary", trials), "labels"
    )
    kept = [c for c in stored.columns if c != "labels"]
    log, paths = literal_table(spark, [], ballots.NEWS), []
    for number in count():
        votes = _by_block(stored, log, ballots.votes, ballots.VOTES.format(kind=kind), trials, number)
        restless = _wanted(votes, keep_current=True).where("wanted <> label")
        turn = F.xxhash64("key", "trial", F.lit(number), F.lit(seed))
        asking = restless.join(met, "id").select("block", "trial", "id", "wanted", turn.alias("turn"))
        heard = _by_block(stored.select(kept), asking, ballots.verdicts, ballots.VERDICTS, trials).groupBy("trial", "id").agg(
            F.max("label").alias("wanted"), F.coalesce(F.bool_or("beaten"), F.lit(False)).alias("beaten"),
            F.bool_or("told").alias("told"),
        )
        seen = Observation()
        news, path = write_stage(
            heard.observe(seen, F.count("wanted").alias("n")).join(met, "id").select(
                "block", "trial", "id", F.when(~F.col("beaten"), F.col("wanted")).alias("label"),
                F.col("wanted").isNotNull().alias("restless"), (F.col("beaten") | F.col("told")).alias("again"),
                F.lit(number).alias("number"),
            ), "news",
        )
        paths.append(path)
        left = seen.get["n"]
        if not left:
            break
        if max_iter is not None and number + 1 >= max_iter:
            raise NotSettled(f"{left} labels not settled after {max_iter} rounds")
        log = log.unionByName(news) if number else news
        if number % RENEWED == RENEWED - 1:
            fresh, path = write_stage(_by_block(stored, log, ballots.renewed, stored.schema, trials), "labels")
            for old in (held, *paths[:-1]):
                drop_stage(spark, old)
            stored, held, log, paths = fresh, path, news, paths[-1:]
    named = [ids.select(F.col("id").alias(f"_{c}"), F.col("key").alias(c)) for c in ("id", "label")]
    found = _by_block(stored, log, ballots.listed, ballots.LABELS, trials).withColumnsRenamed({"id": "_id", "label": "_label"})
    found = found.join(named[0], "_id").join(named[1], "_label").select("trial", "id", "label")
    labels = materialise(found.unionByName(alone), "labels")
    for old in (held, *paths):
        drop_stage(spark, old)
    return labels


def unsettled(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """Vertices (id, label, wanted) of a membership (id, label) that want another label."""
    labels = membership.select(F.lit(0).alias("trial"), "id", "label")
    wanted = label_round(_weighted_ends(graph), labels, None, keep_current=True)
    return wanted.where("wanted <> label").select("id", "label", "wanted")


def renumber_communities(membership: DataFrame) -> DataFrame:
    """Community numbers 1, 2, …: largest first, then the one with the smallest member."""
    groups = membership.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first")
    )
    ranked = numbered(groups, [F.desc("n"), F.asc("first")], "community")
    return skew_safe_join(membership, ranked, ["label"], "left", salt_on=["id"]).select(
        "id", "community", "n"
    )


def _xlog2x(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def partition_quality(graph: DataFrame, membership: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Modularity and two-level map-equation code length of a vertex partition.

    ``graph``: src, dst, weight. ``membership``: *by, id, label, one row per vertex and
    group of ``by``. All logarithms are taken of plain sums, so every term is one
    aggregate and nothing is joined to a grand total.
    """
    by = list(by)
    weight = F.col("weight").cast("double")
    ends = graph.select("src", "dst", weight.alias("weight"))
    for end, other in (("src", "dst"), ("dst", "src")):
        side = membership.select(*by, F.col("id").alias(end), F.col("label").alias(f"c_{end}"))
        on = [end, *by] if end == "dst" else [end]
        ends = skew_safe_join(ends, side, on, salt_on=[other], counted_on=graph, hot_on=[end])
    same = F.col("c_src") == F.col("c_dst")
    sides = F.array(
        F.struct(F.col("src").alias("id"), F.col("c_src").alias("label")),
        F.struct(F.col("dst").alias("id"), F.col("c_dst").alias("label")),
    )
    halves = ends.withColumn("within", same).select(*by, "weight", "within", F.inline(sides))
    nodes = halves.groupBy(*by, "label", "id").agg(
        F.sum("weight").alias("strength"),
        F.sum(F.when(F.col("within"), F.col("weight")).otherwise(0.0)).alias("inside"),
    )
    groups = nodes.groupBy(*by, "label").agg(
        F.sum("strength").alias("strength"),
        F.sum("inside").alias("inside"),
        F.sum(_xlog2x(F.col("strength"))).alias("node_term"),
    )
    cut = F.col("strength") - F.col("inside")
    total = F.sum("strength")
    all_cut = F.sum(cut)
    # Σ plogp(x / T) = Σ x·log2 x / T − log2(T) · Σ x / T, for T the total strength.
    def plogp_sum(x_log_x: Column, x: Column) -> Column:
        return x_log_x / total - F.log2(total) * x / total

    length = (
        F.when(all_cut > 0, all_cut / total * F.log2(all_cut / total)).otherwise(0.0)
        - 2 * plogp_sum(F.sum(_xlog2x(cut)), all_cut)
        - plogp_sum(F.sum("node_term"), total)
        + plogp_sum(F.sum(_xlog2x(cut + F.col("strength"))), all_cut + total)
    )
    modularity = F.sum("inside") / total - F.sum(F.pow("strength", F.lit(2.0))) / (total * total)
    return groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("communities"),
        modularity.alias("modularity"),
        length.alias("codelength"),
    )


def communities(
    graph: DataFrame, trials: int = TRIALS, max_iter: int | None = None, seed: int = 725
) -> DataFrame:
    """Best of several label-propagation runs by code length: (id, community, n)."""
    labels = settled_labels(graph, trials, max_iter, seed)
    quality = partition_quality(graph, labels, by=["trial"])
    best = quality.orderBy("codelength", "trial").first()["trial"]
    return renumber_communities(labels.where(F.col("trial") == best).drop("trial"))
