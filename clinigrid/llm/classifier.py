"""Quality by a hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text is seen twice: as its words, lower-cased, and as their shapes, in which letters,
capitals and digits stand for their kinds. Single words and pairs of neighbours of either
view are hashed to places of one weight vector. Training rows are dealt to a fixed number
of shards; each passes over its rows one by one (FTRL-proximal), the shards' states are
averaged, and the next round goes on from there. A score is a sparse dot product.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, documents, emit, raw, ship
from clinigrid.session import materialise

# Labelled documents that are learned from: the first by a hash of their id. A documented bound.
MAX_TRAINING_ROWS = 20_000
# Places of the weight vector: 2 MB of weights in every task, whatever the input.
BITS = 18
PLACES = 1 << BITS
# Training rows are dealt to so many shards, and passed over so often.
SHARDS, ROUNDS = 8, 4
# FTRL-proximal: learning rate, its smoothing, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
# Length of a text's vector in either view.
SCALE = 4.0
THRESHOLD = 0.3
# Weights travel in blocks of so many places.
BLOCK = 1 << 12
# Odd 64-bit multipliers of the hashes.
MIX_ONE, MIX_LEFT, MIX_PAIR = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
# Added to hashes of shapes, so that a shape is no word; a word equal to the one before has a shape of its own.
SHAPES, SAME = 7, 1
# Byte by byte: capitals, other letters and parts of letters, digits; other signs stay.
KINDS = bytes(
    ord("A") if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else ord("a") if b >= 128 or chr(b).islower()
    else ord("0") if chr(b).isdigit() else b for b in range(256)
)
RUN = re.compile(rb"(.)\1+")
KEPT_SHAPES, SHAPE_CHARS = 50_000, 64


def held_out(doc_id) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0; a missing id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Features:
    """Places and values of texts, with the shapes that a task has seen."""

    def __init__(self):
        self.shapes: dict[bytes, int] = {}

    def shape(self, kinds: bytes) -> int:
        found = self.shapes.get(kinds)
        if found is None:
            found = crc32(RUN.sub(rb"\1", kinds))
            if len(kinds) <= SHAPE_CHARS and len(self.shapes) < KEPT_SHAPES:
                self.shapes[kinds] = found
        return found

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of a text without words nothing."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        hashes = np.fromiter(map(crc32, words), np.uint64, len(words))
        shapes = np.fromiter(map(self.shape, text.translate(KINDS).split()), np.uint64, len(words))
        shapes[1:][hashes[1:] == hashes[:-1]] = SAME
        views = [hashed(hashes, 0), hashed(shapes, SHAPES)]
        return np.concatenate([v[0] for v in views]), np.concatenate([v[1] for v in views])


def hashed(hashes: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of single hashes and of neighbours, each once, with damped counts, SCALE long together."""
    shift, salt = np.uint64(64 - BITS), np.uint64(salt)
    ones = (hashes + salt) * np.uint64(MIX_ONE) >> shift
    pairs = (hashes[:-1] * np.uint64(MIX_LEFT) + hashes[1:] * np.uint64(MIX_ONE) + salt) * np.uint64(MIX_PAIR) >> shift
    places, counts = np.unique(np.concatenate([ones, pairs]), return_counts=True)
    values = np.log1p(counts)
    return places.astype(np.int64), values * (SCALE / np.sqrt((values * values).sum()))


class Learner:
    """The state of FTRL-proximal: sums ``z`` and squared gradients ``n``; the last place is the constant's."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z.copy(), n.copy()

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, inverse = np.unique(np.append(places, PLACES), return_inverse=True)
        x = np.bincount(inverse, np.append(values, 1.0))
        z, n = self.z[at], self.n[at]
        w = weights(z, n)
        g = (chance(w @ x) - label) * x
        more = n + g * g
        self.z[at] = z + g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def chance(logit: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, float(logit))))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(shard, drawn, text, quality) of the documents of at most ``max_rows`` labelled ids outside the held-out fifth.

    An id that is labelled more than once counts as good if any label says so. The labels
    are bounded before they are broadcast, so texts stay where they are.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    drawn = F.xxhash64("doc_id")
    n = usable.count()
    if n > 2 * max_rows:
        # Half as many again as needed: so the sort does not see all labels.
        usable = usable.where(drawn < int((1.5 * max_rows / n - 0.5) * 2**64))
    wanted = (
        usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(drawn, "doc_id").limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    # The draw kept the least hashes, so shards take the middle bits.
    shard = F.pmod(F.shiftright(drawn, 20), F.lit(SHARDS)).cast("int")
    return found.select(shard.alias("shard"), drawn.alias("drawn"), "text", "quality")


def train(training: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of all places and of the constant, from (shard, drawn, text, quality) rows.

    Rows are turned to places and values once. In every round a task passes over its
    shards' rows in the order of their draw; two states of PLACES numbers a shard are
    averaged by block, and the average (4 MB) reaches the driver and the next round. All
    is done in a fixed order, so the same rows give the same weights. Without rows all
    weights are 0.
    """
    def start_features():
        features = Features()

        def step(batch):
            found = [features(t) for t in raw(batch)]
            return [p.astype("<i4").tobytes() for p, _ in found], [v.astype("<f8").tobytes() for _, v in found]

        return step

    made = append(training, start_features, "places binary, vals binary")
    rows = materialise(made.select("shard", "drawn", "quality", "places", "vals"), "features")
    state = np.zeros((2, PLACES + 1))
    for _ in range(rounds):
        state = _one_round(rows, state)
    return weights(*state)


def _one_round(rows: DataFrame, state: np.ndarray) -> np.ndarray:
    held = rows.sparkSession.sparkContext.broadcast(state)

    def start():
        current = [None, None]

        def told():
            shard, learner = current
            if learner is None:
                return None
            both = np.stack([learner.z, learner.n])
            cuts = range(0, both.shape[1], BLOCK)
            return (
                [shard] * len(cuts), list(range(len(cuts))),
                [both[:, at:at + BLOCK].astype("<f8").tobytes() for at in cuts],
            )

        def step(batch):
            out = None
            columns = (batch.column(c).to_pylist() for c in ("shard", "quality", "places", "vals"))
            for shard, label, places, values in zip(*columns):
                if shard != current[0]:
                    done = told()
                    if done:
                        out = done if out is None else tuple(a + b for a, b in zip(out, done))
                    current[:] = shard, Learner(*held.value)
                current[1].learn(np.frombuffer(places, "<i4").astype(np.int64), np.frombuffer(values, "<f8"), int(label != 0))
            return out

        return step, told

    def averaged(block: pa.Table) -> pa.Table:
        block = block.sort_by("shard")
        mean = np.mean([np.frombuffer(b, "<f8") for b in block.column("state").to_pylist()], axis=0)
        return pa.table({"block": block.column("block")[:1], "state": [mean.astype("<f8").tobytes()]})

    # A shard is a stretch of one task's rows; a task may have several.
    dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "drawn", "quality", "places", "vals")
    shards = emit(dealt, start, "shard int, block int, state binary")
    # A group is one block of SHARDS states, 512 KB.
    mean = shards.groupBy("block").applyInArrow(averaged, "block int, state binary").collect()
    fresh = state.copy()
    for row in mean:
        part = np.frombuffer(row["state"], "<f8").reshape(2, -1)
        fresh[:, row["block"] * BLOCK:row["block"] * BLOCK + part.shape[1]] = part
    held.unpersist()
    return fresh


def with_scores(docs: DataFrame, learned: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def start():
        features, w = Features(), held.value

        def one(text):
            places, values = features(text)
            return chance(w[places] @ values + w[PLACES])

        return lambda batch: [[one(t) for t in raw(batch)]]

    return append(docs, start, "score double")


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with ``score`` and ``predicted``.

    Whole texts are scored one by one, so repeated rows score alike and an empty table
    gives an empty result. Missing texts, empty ones and such without words have the
    constant alone. Without labels every score is 0.5.
    """
    learned = train(training_rows(docs, labels, max_rows))
    return with_scores(docs, learned).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, labels).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


ship(__name__)
