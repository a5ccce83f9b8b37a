"""The quality classifier against a plain version of the whole query, and on held-out rows."""

import math
import random
import re
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from clinigrid.llm import classifier
from clinigrid.llm.registry import QUERIES

WORD = 0xFFFFFFFFFFFFFFFF


def plain_features(text):
    """Places with values, from dictionaries and whole numbers only."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), data))
    kinds = re.sub(rb"[0-9]", b"0", re.sub(rb"[\x80-\xff]", b"a", re.sub(rb"[a-z]", b"a", re.sub(rb"[A-Z]", b"A", data))))
    shapes = [zlib.crc32(re.sub(rb"(.)\1+", rb"\1", k)) for k in re.findall(rb"[^\x20\x09-\x0D]+", kinds)]
    hashes = [zlib.crc32(w) for w in words]
    shapes = [1 if i and hashes[i] == hashes[i - 1] else s for i, s in enumerate(shapes)]
    out = []
    for view, salt in ((hashes, 0), (shapes, 7)):
        counts = {}
        for h in view:
            at = ((h + salt) * 0x9E3779B97F4A7C15 & WORD) >> 46
            counts[at] = counts.get(at, 0) + 1
        for a, b in zip(view, view[1:]):
            mixed = a * 0xC2B2AE3D27D4EB4F + b * 0x9E3779B97F4A7C15 + salt & WORD
            at = (mixed * 0xD6E8FEB86659FD93 & WORD) >> 46
            counts[at] = counts.get(at, 0) + 1
        size = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        out += [(at, 4.0 * math.log1p(c) / size) for at, c in counts.items()]
    joined = {}
    for at, v in out:
        joined[at] = joined.get(at, 0.0) + v
    return joined


def plain_scores(texts, rows):
    """``rows`` are (shard, drawn, text, quality); FTRL-proximal one coordinate at a time."""
    z, n = {}, {}

    def weight(z, n, k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= 1e-3 else -(zk - math.copysign(1e-3, zk)) / ((1 + math.sqrt(nk)) / 0.5 + 1e-3)

    def chance(logit):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, logit))))

    shards = sorted({r[0] for r in rows})
    for _ in range(4 if rows else 0):
        states = []
        for shard in shards:
            zs, ns = dict(z), dict(n)
            for _, _, text, label in sorted((r for r in rows if r[0] == shard), key=lambda r: r[1]):
                x = {**plain_features(text), "constant": 1.0}
                w = {k: weight(zs, ns, k) for k in x}
                error = chance(sum(w[k] * v for k, v in x.items())) - label
                for k, v in x.items():
                    g = error * v
                    more = ns.get(k, 0.0) + g * g
                    zs[k] = zs.get(k, 0.0) + g - (math.sqrt(more) - math.sqrt(ns.get(k, 0.0))) / 0.5 * w[k]
                    ns[k] = more
            states.append((zs, ns))
        every = {k for s in states for k in s[0]}
        z = {k: sum(s[0].get(k, 0.0) for s in states) / len(states) for k in every}
        n = {k: sum(s[1].get(k, 0.0) for s in states) / len(states) for k in every}
    return [
        chance(sum(weight(z, n, k) * v for k, v in {**plain_features(t), "constant": 1.0}.items())) for t in texts
    ]


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    usual = "river stone light house Winter garden letter 12 été".split()
    rows, labels = [], []
    for i in range(120):
        words = rng.choices(usual, k=rng.randint(5, 40))
        good = int(i % 4 != 0)
        if not good:
            words = [w + "###" for w in words] if i % 8 else [words[0]] * 20
        rows.append((i, " ".join(words)))
        labels.append((i, good))
    rows += [(i, t and t[:2000]) for i, t in cases.TEXTS if i is not None and i < 0] + [(500, None), (501, ""), (502, " \n")]
    labels += [(None, 1), (3, None), (9999, 1), (7, 0)]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int"),
    )


def test_query_equals_a_plain_version(spark, table, small):
    docs, labels = small
    got = QUERIES["op13_quality_classifier"](spark, table(documents=docs, labels=labels)).collect()
    rows = [tuple(r) for r in classifier.training_rows(docs, labels).collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = dict(zip(texts, plain_scores(texts.values(), rows)))
    assert len(got) == len(texts) and {r["doc_id"] for r in got} == set(texts)
    for r in got:
        assert r["score"] == pytest.approx(expected[r["doc_id"]], abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    truth = {i: int(i % 4 != 0) for i in range(120)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 15 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9


def test_held_out_labels_are_not_learned(spark, small):
    docs, labels = small
    lied = labels.withColumn("quality", F.when(classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in classifier.score_quality(docs, x).collect()} for x in (labels, lied))
    assert a == b


def test_training_rows_are_the_first_by_hash(spark):
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = {int(r["text"]) for r in classifier.training_rows(docs, labels, 40).collect()}
    usable = labels.where(~classifier.held_out("doc_id"))
    assert got == {r["doc_id"] for r in usable.orderBy(F.xxhash64("doc_id")).limit(40).collect()}


def test_scores_do_not_depend_on_partitions(small):
    docs, labels = small
    a, b = (
        {r["doc_id"]: r["score"] for r in classifier.score_quality(docs.repartition(n), labels.repartition(n)).collect()}
        for n in (2, 7)
    )
    assert a == b


def test_without_labels_and_on_long_texts(spark):
    docs = cases.documents(spark, [*cases.TEXTS, (40, "x" * 300_000), (41, "Word!! " * 50_000)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = classifier.score_quality(docs.drop("score"), none)
    assert got.count() == len(cases.TEXTS) + 2 and got.where("score <> 0.5 or predicted <> 1").count() == 0
    assert "doc" in got.columns
