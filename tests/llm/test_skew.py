"""Removal of repeats where one anchor or one document has most of the entries."""

import random

import cases
from pyspark.sql import functions as F

from clinigrid.llm import repeats

WORD = "the same passage of every document, "


def around(n, seed=1):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices("abcdefgh", k=60)) + WORD + "".join(rng.choices("abcdefgh", k=60))) for i in range(n)]


def light(spark, texts):
    docs = cases.documents(spark, texts, clashing=False)
    return docs.select(F.col("doc_id").alias("doc"), F.hash("text").cast("bigint").alias("key"), "text")


def entries(packed):
    rows = packed.where(F.col("kind") != 1).groupBy("bucket").agg(F.sum(F.octet_length("place") / 4).alias("n")).collect()
    return [int(r["n"]) for r in rows]


def check(spark, texts):
    found = repeats.remove_repeats(cases.documents(spark, texts)).select(
        "doc.doc_id", "n_bytes", "spans", F.sha2("kept", 256))
    got = sorted((str(i), n, sum(e - s for s, e in spans), len(spans), h) for i, n, spans, h in found.collect())
    assert got == sorted((str(i), *r) for (i, _), r in zip(texts, cases.repeats(texts)))


def test_strings_of_a_hot_anchor_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(repeats, "DRAWN_OF", 4)
    rows = light(spark, around(600))
    hot = repeats.hot_anchors(rows, 50)
    assert len(hot) > 0
    sizes = entries(repeats.run_entries(rows, 50, 16, hot))
    assert max(sizes) < 2 * sum(sizes) / 16


def test_ordinary_anchors_fill_buckets_evenly(spark):
    rng = random.Random(2)
    sizes = entries(repeats.run_entries(light(spark, [(1, "".join(rng.choices("abcdefgh", k=200_000)))]), 50, 16))
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


def test_results_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "DRAWN_OF", 4)
    monkeypatch.setattr(repeats, "HOT_DRAWN", 2)
    monkeypatch.setattr(repeats, "BUCKET_ENTRIES", 50)
    texts = around(80)
    check(spark, texts + [(i + 100, t[20:] + t) for i, t in texts[:30]] + [(7, WORD * 5), (300, texts[0][1][30:130])])


def test_a_repeating_document_has_few_entries(spark):
    rows = light(spark, [(1, " " * 400_000), (2, "one line that comes again and again, always\n" * 9000)])
    assert sum(entries(repeats.run_entries(rows, 50, 4))) < 200


def test_results_of_repeating_documents(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
    line = "one line that comes again and again, always\n"
    check(spark, [
        (1, " " * 60 + line), (2, " " * 2000 + "x" + " " * 900), (3, line * 40), (4, (line + "x") * 30 + line * 9),
        (5, "y" + line * 2), (6, line[5:] + line + "z"), (6, line * 30), (None, line * 8 + " " * 99),
    ])
