"""The prefix trie against a plain version: dictionaries of whole prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clinigrid.llm import conversation_trie as trie
from clinigrid.llm.registry import QUERIES

KINDS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    """Rows of the query by conv_id and depth, from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    found, todo = {}, sorted(members, key=len, reverse=True)
    leaves, saved = {}, {}
    for path in todo:
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = sum(saved[p] for p in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ends = sorted(c for c in members[path] if len(whole[c]) == len(path))
        key = (min(members[path]), len(path))
        assert key not in found
        found[key] = (
            min(members[path[:-1]]) if path else None, len(members[path]), len(below), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return found


def check(spark, table, rows):
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(c) for c in ("id", "depth", "t0", "block", "p")})
    got = QUERIES["op12_conversation_trie"](spark, table(conversations=df)).collect()
    expected = plain_trie(rows)
    assert len(got) == len(expected)
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == expected


def conversations(rng, ids, longest, texts):
    return [
        (c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", rng.choice(texts if t > 1 else texts[:2]))
        for c in ids for t in range(rng.randint(1, longest))
    ]


def test_families_and_common_beginnings(spark, table):
    rng = random.Random(1)
    ids = [*range(0, 8), *range(100, 140), 200, 299, 305, 306, 307, 10**12 + 7]
    rows = conversations(rng, ids, 6, ["a", "bé😀", "", "long text"])
    rows += [(50, None, None, None), (50, None, "user", None), (50, 3, "user", "x"), (50, 3, "user", "x"), (50, 3, None, "y"),
             (None, 1, "user", "nobody's"), (51, 0, "a", "b"), (52, 0, "ab", ""), (53, 0, "", "ab")]
    rng.shuffle(rows)
    check(spark, table, rows)


@pytest.mark.parametrize("stretch", [3, 1024])
def test_long_conversations_go_on_in_further_blocks(spark, table, monkeypatch, stretch):
    monkeypatch.setattr(trie, "STRETCH_TURNS", stretch)
    monkeypatch.setattr(trie, "STRETCH_BLOCKS", min(stretch, 128))
    rng = random.Random(stretch)
    common = [rng.choice("abc") * 3 for _ in range(90)]
    rows = []
    for c, n in enumerate([90, 90, 90, 41, 40, 33, 32, 17, 16, 15, 9, 8, 7, 1], start=600):
        own = common[:rng.choice([n, n, n // 2])]
        rows += [(c, t, "user", x) for t, x in enumerate(own + ["z"] * (n - len(own)))]
    check(spark, table, rows)


def test_many_equal_conversations(spark, table, monkeypatch):
    """Most conversations end in one node; their ids are hashed over several ranges."""
    monkeypatch.setattr(trie, "ENDS_RANGE", 16)
    rows = [(c, t, "user", "same") for c in range(-60, 240) for t in range(8)]
    # A remainder below 0 has another sign in Python.
    rows = [r for r in rows if r[0] >= 0] + [(1000 + c, t, "user", "same") for c in range(0, 90) for t in range(8)]
    check(spark, table, rows)


def test_turnless_conversations_are_members_of_the_root(spark, table):
    ids = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = [(c, 0, "user", "x") for c in ids]
    assert plain_trie(rows).keys() == {(min(ids), 0)}
    check(spark, table, rows)


def test_nothing(spark, table):
    empty = table(conversations=spark.createDataFrame([], KINDS))
    assert QUERIES["op12_conversation_trie"](spark, empty).count() == 0
    nobody = table(conversations=spark.createDataFrame([(None, 1, "user", "x")], KINDS))
    assert QUERIES["op12_conversation_trie"](spark, nobody).count() == 0
