"""Prefix trie of conversations by SQL ROLLUP over positional turn-id columns.

A turn's id stands for its role and text, so texts are read once and never move. The ids of
BLOCK consecutive turns are columns of one row; ROLLUP over them makes all prefixes of the
block at once, and grouping_id tells how long each is. A long conversation goes on in further
rows, keyed by the node in which the row before ends. That node is known by a hash over the
path to it, so rows of all blocks are rolled up in one query however long conversations are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinigrid.llm.common import emit, ship
from clinigrid.operators.joins import skew_safe_join
from clinigrid.session import materialise

# Turns a row of id columns holds.
BLOCK = 8
# Turns and blocks are numbered within stretches first, then over stretches.
STRETCH_TURNS, STRETCH_BLOCKS = 1024, 128
# Conversations of a contract's family of so many may begin with turns of its first one, at most MAX_SHARED - 1 of them.
FAMILY, MAX_SHARED = 100, 6
# Ids that are joined to one string before they are hashed in order.
ENDS_RANGE = 4096
IDS = [f"t{i}" for i in range(BLOCK)]
# A node is known by its depth and two hashes over the path to it.
NODE = ["depth", "x1", "x2"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id): ``id`` is a 128-bit digest of role and text, a colon, and the text's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.concat(F.substring(digest, 1, 32), F.lit(":"), F.length(text).cast("string")).alias("id"),
    )


def chars_of(turn_id) -> Column:
    """Code points of the text that an id stands for; 0 for none."""
    return F.coalesce(F.substring_index(turn_id, ":", -1).cast("bigint"), F.lit(0))


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, p, id): turns numbered from 1 in the order of ``turn``, missing first, then of their ids.

    A prefix scan of two levels, so that one very long conversation is not sorted by one task.
    """
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH_TURNS), F.lit(-(1 << 62))).cast("bigint")
    rows = turns.withColumn("stretch", stretch)
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "id")
    over = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before")
    )
    numbered = rows.withColumn("p", F.row_number().over(inside))
    return numbered.join(counts, ["conv_id", "stretch"]).select("conv_id", (F.col("before") + F.col("p")).alias("p"), "id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id) of conversations that share first turns with their family's first, and
    (conv_id, n_turns) of all conversations. ``turns`` is stored."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_SHARED
    lengths = turns.groupBy("conv_id").agg(F.max("p").alias("own"))
    convs = lengths.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    firsts = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    convs = materialise(convs.join(firsts, "base", "left").withColumn("taken", taken), "conversations")
    # At most FAMILY conversations meet fewer than MAX_SHARED turns of a base.
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("p") < MAX_SHARED)).withColumnRenamed("conv_id", "base")
    given = convs.join(heads, "base").where("p <= h").select("conv_id", F.col("p").alias("pos"), "id")
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("p > h").select(
        "conv_id", (F.col("taken") + F.col("p") - F.col("h")).alias("pos"), "id"
    )
    sizes = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return given.unionByName(kept), sizes


def step_hash(turn_id, pos, salt: int) -> Column:
    return F.xxhash64(turn_id, pos, F.lit(salt))


def block_rows(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row of BLOCK id columns per conversation and block, with what its path before is:
    hashes ``b1`` and ``b2`` and ``chars_before``. A conversation of no turns has one empty row."""
    at = F.col("pos") - 1
    rows = turns.select(
        "conv_id", F.floor(at / BLOCK).cast("bigint").alias("block"), (at % BLOCK).alias("k"), "id",
        step_hash("id", F.col("pos").cast("bigint"), 1).alias("s1"),
        step_hash("id", F.col("pos").cast("bigint"), 2).alias("s2"), chars_of("id").alias("chars"),
    )
    sums = [F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("chars").alias("chars")]
    made = materialise(rows.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("k") == i, F.col("id"))).alias(c) for i, c in enumerate(IDS)], *sums
    ).withColumn("stretch", F.floor(F.col("block") / STRETCH_BLOCKS)), "turn-blocks")

    def before(columns, window):
        zero = F.lit(0).cast("bigint")
        return [
            F.coalesce(how(c).over(window), zero).alias(name)
            for how, c, name in zip((F.bit_xor, F.bit_xor, F.sum), ("s1", "s2", "chars"), columns)
        ]

    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = made.groupBy("conv_id", "stretch").agg(*sums)
    earlier = stretches.select("conv_id", "stretch", *before(("o1", "o2", "o_chars"), over))
    near = made.select("conv_id", "stretch", "block", *IDS, "s1", "s2", "chars", *before(("i1", "i2", "i_chars"), inside))
    filled = near.join(earlier, ["conv_id", "stretch"]).select(
        "conv_id", "block", *IDS, "s1", "s2", "chars",
        F.col("o1").bitwiseXOR(F.col("i1")).alias("b1"), F.col("o2").bitwiseXOR(F.col("i2")).alias("b2"),
        (F.col("o_chars") + F.col("i_chars")).alias("chars_before"),
    )
    none = {c: F.lit(0).cast("bigint") for c in ("block", "s1", "s2", "chars", "b1", "b2", "chars_before")}
    empty = sizes.where("n_turns = 0").select("conv_id").withColumns(
        {**none, **{c: F.lit(None).cast("string") for c in IDS}}
    )
    return filled.unionByName(empty)


def rolled_up(blocks: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """All prefixes of all block rows with the aggregates of their members, as nodes.

    ``aggregates`` are SQL expressions by name. Of a node are told: NODE, its parent's
    hashes ``p1`` and ``p2``, ``last_chars``, and ``chars_above``, those of the turns above it.
    """
    told = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    names = ", ".join(IDS)
    found = blocks.sparkSession.sql(
        f"SELECT block, b1, b2, {names}, {BLOCK} - bit_count(grouping_id()) AS level, "
        f"min(chars_before) AS chars_before, {told} "
        f"FROM {{blocks}} GROUP BY block, b1, b2, ROLLUP ({names})", blocks=blocks,
    )
    last = F.get(F.array(*IDS), F.col("level") - 1)
    # A row that ends within its block makes no longer prefixes; a block's own start is the node before it.
    found = found.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    steps = {}
    for salt in (1, 2):
        path = F.col(f"b{salt}")
        for i, c in enumerate(IDS):
            pos = F.col("block") * BLOCK + i + 1
            path = path.bitwiseXOR(F.when(F.col(c).isNotNull(), step_hash(c, pos, salt)).otherwise(F.lit(0).cast("bigint")))
        steps[f"x{salt}"] = path
    depth = F.col("block") * BLOCK + F.col("level")
    above = F.col("chars_before") + sum((chars_of(c) for c in IDS), F.lit(0)) - chars_of(last)
    mine = {f"s{salt}": F.when(F.col("level") > 0, step_hash(last, depth, salt)).otherwise(F.lit(0).cast("bigint")) for salt in (1, 2)}
    return found.select(
        depth.alias("depth"), *[c.alias(n) for n, c in steps.items()],
        *[steps[f"x{s}"].bitwiseXOR(mine[f"s{s}"]).alias(f"p{s}") for s in (1, 2)],
        chars_of(last).alias("last_chars"), above.alias("chars_above"), *aggregates,
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """NODE with the digest of the ids of conversations that end there, ascending, comma-joined.

    Ids are joined by range first. A SHA-256 is made in order, so one task streams a
    node's strings through it and holds one batch of them, however many end there.
    """
    ranges = ends.groupBy(*NODE, F.floor(F.col("conv_id") / ENDS_RANGE).alias("range")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids")
    )

    def start():
        current = [None, None]

        def step(batch):
            done = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if key != current[0]:
                    if current[0] is not None:
                        done.append((*current[0], current[1].hexdigest()))
                    current[:] = key, hashlib.sha256(ids.encode())
                else:
                    current[1].update(b"," + ids.encode())
            return list(zip(*done)) or None

        def finish():
            return None if current[0] is None else [[v] for v in (*current[0], current[1].hexdigest())]

        return step, finish

    dealt = ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range")
    return emit(dealt, start, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, from (conv_id, pos, id) and (conv_id, n_turns) of all of them.

    Sums over a subtree come from its members, not from its nodes: of a node every member
    but the smallest adds the characters and leaves that it owns, those of nodes in which
    it is the smallest. The smallest owns all from the node on. So no level waits for another.
    """
    blocks = materialise(block_rows(turns, sizes), "prefix-blocks")
    nodes = materialise(rolled_up(blocks, {"n_convs": "count(1)", "conv_id": "min(conv_id)"}), "prefix-nodes")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    zero = F.lit(0).cast("bigint")
    nodes = materialise(
        nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "prefix-nodes"
    )
    owned = nodes.groupBy("conv_id").agg(
        F.sum("last_chars").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    # What a conversation has in all, and the node where it ends.
    ends = blocks.groupBy("conv_id").agg(
        F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.sum("chars").alias("total")
    ).join(sizes, "conv_id").join(owned, "conv_id", "left").select(
        "conv_id", F.col("n_turns").cast("bigint").alias("depth"), "x1", "x2", "total",
        F.coalesce("owned", zero).alias("owned"), F.coalesce("leaves", zero).alias("leaves"),
    )
    ends = materialise(ends, "prefix-ends")
    weighted = blocks.select("conv_id", "block", "b1", "b2", "chars_before", *IDS).join(
        ends.select("conv_id", "total", "owned", "leaves"), "conv_id"
    )
    sums = rolled_up(weighted, {
        "n": "count(1)", "total": "sum(total)", "owned": "sum(owned)", "n_leaves": "sum(leaves)",
        "least": "min(struct(conv_id, total, owned))",
    })
    all_chars = F.col("total") - F.col("n") * F.col("chars_above")
    once = F.col("owned") - F.col("least.owned") + F.col("least.total") - F.col("chars_above")
    sums = sums.select(*NODE, "n_leaves", (all_chars - once).alias("saved_tokens"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    whole = nodes.join(sums, NODE).join(end_digests(ends.select(*NODE, "conv_id")), NODE, "left")
    whole = materialise(whole.drop("last_chars", "chars_above"), "prefix-nodes")
    # The root and other common nodes have very many children.
    found = skew_safe_join(whole, parents, ["depth", "p1", "p2"], "left", salt_on=["conv_id"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) after they are rebuilt, one row a node.

    Missing roles and texts are empty ones; a missing turn comes first, and turns of equal
    number stand in the order of their ids. Rows without a conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own. An empty table has
    no node, not even a root. Other columns are not looked at.
    """
    turns = materialise(placed(turn_ids(conversations)), "turns")
    return prefix_trie(*rebuilt(turns))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return shared_prefixes(
        spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    )


# The trie by grouping whole prefixes; crc32 is folded over the digits by its table.
OP12_SQL = """
WITH crc AS (
    SELECT list(list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), own AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        left(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 32)) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, c - c % 100 AS b, xor(list_reduce(
        list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM own), crc
), turns AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, r, x FROM (
        SELECT convs.c, 0 AS part, p, r, x FROM convs JOIN own ON own.c = b AND p <= h
        UNION ALL SELECT c, 1, p, r, x FROM convs JOIN own USING (c) WHERE p > h)
), member AS (
    SELECT c, d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS path, length(x) AS chars FROM turns
    UNION ALL SELECT c, 0, [], 0 FROM convs
), node AS (
    SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM member GROUP BY path, d
), place AS (
    SELECT member.c, d, node.conv_id, n, node.chars FROM member JOIN node USING (path, d)
), tree AS (
    SELECT node.conv_id, node.d, n, chars, up.conv_id AS parent
    FROM node LEFT JOIN (SELECT c, d, conv_id FROM place) up ON up.c = node.conv_id AND up.d = node.d - 1
), children AS (
    SELECT parent AS conv_id, d - 1 AS d, count(*) AS k FROM tree WHERE d > 0 GROUP BY ALL
), sub AS (
    SELECT a.conv_id, a.d, sum((x.n - 1) * x.chars) AS saved, count(*) FILTER (k IS NULL) AS leaves
    FROM tree x LEFT JOIN children USING (conv_id, d) JOIN place a ON a.c = x.conv_id AND a.d <= x.d GROUP BY ALL
), ends AS (
    SELECT conv_id, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
    FROM place JOIN (SELECT c, max(d) AS d FROM member GROUP BY c) USING (c, d) GROUP BY ALL
)
SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
    leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM tree LEFT JOIN children USING (conv_id, d) JOIN sub USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
"""

ship(__name__)
