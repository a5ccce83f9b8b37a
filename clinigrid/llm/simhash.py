"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments. Two that differ in at most two bits
agree in one segment and differ by at most one bit in another, so each pair (exact
segment, fuzzy segment) gives keys: the exact bits with the Golay codewords near the
fuzzy ones. Words one bit apart always share a codeword, see ``near_codewords``.
"""

from __future__ import annotations

from itertools import accumulate, combinations, permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, documents, emit, pack, raw, rows_of, ship
from clinigrid.operators.joins import skew_safe_join
from clinigrid.session import drop_stage, materialise, write_stage

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
# Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Buckets up to this size are compared pair by pair; larger ones meet at hubs.
SMALL_BUCKET = 16
HASH_BLOCK = 1 << 16


def fingerprint(words: list[bytes], shingle_words: int, seed: int, xxh64) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit number; 0 for no words."""
    if not words:
        return 0
    if len(words) < shingle_words:
        hashes = np.array([xxh64(b" ".join(words), seed)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = list(accumulate((len(w) + 1 for w in words)))
        starts = [0, *ends]
        hashes = np.array(
            [xxh64(joined[s:e - 1], seed) for s, e in zip(starts, ends[shingle_words - 1:])], dtype=np.uint64
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASH_BLOCK):
        part = hashes[at:at + HASH_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(packed: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    def start():
        from xxhash import xxh64_intdigest

        return lambda batch: [
            [fingerprint(t.lower().split(), shingle_words, seed, xxh64_intdigest) for t in raw(batch)]
        ]

    return append(packed, start, "fp bigint")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bytes (three tables), and per syndrome the errors of weight 4 or less.

    The code corrects 3 errors, so every word has one codeword within 3 bits; those that
    are exactly 3 away have five more at 4. Rows are filled up with their first error.
    """
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    syndromes = np.array([[remainder(b << s & 0x7FFFFF) for b in range(256)] for s in (0, 8, 16)], dtype=np.int64)
    lists: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            lists.setdefault(remainder(error), []).append(error)
    width = max(map(len, lists.values()))
    errors = np.array([lists[s] + lists[s][:1] * (width - len(lists[s])) for s in range(2048)], dtype=np.int64)
    return syndromes, errors


def near_codewords(words: np.ndarray, tables) -> np.ndarray:
    """Per 23-bit word the indices of all codewords within 4 bits, padded with the nearest.

    Of two words one bit apart, the codeword nearest to one is within 3 + 1 bits of the
    other: they share an index.
    """
    syndromes, errors = tables
    s = syndromes[0][words & 255] ^ syndromes[1][words >> 8 & 255] ^ syndromes[2][words >> 16]
    return (words[:, None] ^ errors[s]) >> 11


def golay_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp) rows, about 32 a fingerprint."""
    def start():
        tables = golay_tables()

        def step(batch):
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = [(fps.view(np.uint64) >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
            keys, owners = [], []
            near = [near_codewords(b, tables) for b in bits]
            for pair, (exact, fuzzy) in enumerate(permutations(range(3), 2)):
                index = near[fuzzy]
                fresh = np.ones(index.shape, dtype=bool)
                fresh[:, 1:] = index[:, 1:] != index[:, :1]
                key = (pair << 34) | (bits[exact][:, None] << 12) | index
                keys.append(key[fresh])
                owners.append(np.broadcast_to(fps[:, None], index.shape)[fresh])
            return np.concatenate(keys), np.concatenate(owners)

        return step

    return emit(nodes.select("fp"), start, "key bigint, fp bigint")


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: enough links at MAX_BITS or fewer bits to connect whatever is linked.

    ``nodes`` are distinct fingerprints. Members of small buckets are compared directly.
    A fingerprint in any larger bucket meets the others at hubs instead: itself and its 64
    one-bit neighbours. Two fingerprints within two bits share a hub, all at a hub are
    within two bits of each other, and a hub has at most 65, so each hub gives a star.
    """
    keys = materialise(golay_keys(nodes), "golay-keys")
    shared = keys.join(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"
    )
    shared = materialise(shared, "golay-shared")
    small = shared.where(F.col("n") <= SMALL_BUCKET).select("key", "fp")
    direct = (
        small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "key")
        .where((F.col("a") < F.col("b")) & (differing("a", "b") <= MAX_BITS)).select("a", "b")
    )
    crowded = shared.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    flips = [F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)]]
    hubs = crowded.select("fp", F.explode(F.array(*flips)).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"), "fp"
    )
    firsts = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = hubs.join(firsts, "hub").where("a < fp").select("a", F.col("fp").alias("b"))
    return direct.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge.

    Alternating large and small stars; every round is written to shared storage, the one
    before it deleted, until no edge changes. Nodes with very many edges are salted.
    """
    spark = edges.sparkSession
    current, path = write_stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = skew_safe_join(both, low, ["a"], salt_on=["b"]).where("b > a and b <> m").select(
            F.col("b").alias("u"), F.col("m").alias("v")
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")),
                              F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        current, fresh = write_stage(small, "edges")
        drop_stage(spark, path)
        path = fresh
        found = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).collect()[0]
        if found == state:
            # Stars only: every node other than a root has one edge, to its root.
            roots = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = found


def fingerprint_classes(signed: DataFrame) -> DataFrame:
    """(fp, root, component_id) of distinct fingerprints; ``signed`` is a stored (doc_id, fp, …)."""
    nodes = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    linked = components(links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialise(rooted.join(lowest, "root").select("fp", "root", "component_id"), "classes")


def sign(docs: DataFrame, carry, shingle_words: int) -> DataFrame:
    """Stored rows of ``doc``, ``fp``, ``doc_id`` and ``row``, a number that stays with the row."""
    packed = pack(docs, carry, "doc_id")
    return materialise(
        with_fingerprints(packed, shingle_words).select(
            "doc", "doc_id", "fp", F.monotonically_increasing_id().alias("row")
        ), "signed",
    )


def near_duplicates(docs: DataFrame, carry=None, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc`` (the carried columns) of every document with ``fp`` and its class ``component_id``.

    ``component_id`` is the smallest doc_id linked over any number of steps, missing
    where all are missing. Texts of no words have fingerprint 0 and are linked like any
    other; repeated rows share a fingerprint; an empty table gives an empty result. Texts
    are read once.
    """
    signed = sign(docs, carry, shingle_words)
    return signed.join(fingerprint_classes(signed.select("doc_id", "fp")), "fp")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without all but one of each class: the smallest doc_id stays, missing ones
    last, and of equal ones the first row."""
    signed = sign(docs, None, SHINGLE_WORDS)
    light = signed.select("doc_id", "fp", "row")
    placed = light.join(fingerprint_classes(light).select("fp", "root"), "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("row").alias("row"))
    first = placed.groupBy("root").agg(F.min(rank)["row"].alias("row"))
    # The rows that go are few beside the texts, so this join moves little or nothing of the texts.
    going = materialise(light.join(first.select("row"), "row", "left_anti").select("row"), "duplicates")
    return rows_of(signed.join(going, "row", "left_anti"))


def op5_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


ship(__name__)
