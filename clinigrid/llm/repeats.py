"""Repeated passages by a depth-limited radix sort of suffixes.

Only the first ``width`` bytes of a suffix matter: windows of that many bytes are equal
exactly where suffixes stay together through that depth. Sorting all suffixes would move
many times the input, so the digits are taken most significant first and only suffixes
that may still have a partner go on:

1. The first digit of a window is its anchor, the gram of GRAM bytes in it with the least
   hash; neighbouring windows share their anchor, so one entry stands for a run of windows.
   The second digit is the run's whole string. Entries are dealt by the first digit and
   sorted by both. Where runs are equal, all their windows are; where only anchors are
   equal, runs go on, one of each different string.
2. The runs left over are dealt and sorted window by window, through all bytes.

Entries are packed per slice of documents, and of equal ones in a slice only the smallest
document's moves on: the others already have their answer, so a passage that every
document holds arrives once per slice. A string that one document holds many times is one
entry, marked AGAIN; its other places are found again by hash in the last scan. Anchors
with very many different strings are dealt by both digits, and all their strings go on.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, documents, emit, pack, raw, ship, small_batches
from clinigrid.session import materialise

WIDTH = 50
GRAM = 24
BLOCK_BYTES = 1 << 17
# A bucket of entries is sorted in one task: about so many on average.
BUCKET_ENTRIES = 300_000
# Documents are hashed in slices of so many bytes, each in blocks.
SLICE_BYTES = 3 << 20
NO_ID = (1 << 63) - 1
WHOLE, PART, WINDOW = 0, 1, 2
# Marks a place whose string the same document holds at other places too.
AGAIN = 1 << 31
# Strings are drawn one in so many to find hot anchors: those with so many drawn ones, the largest first.
DRAWN_OF = 256
HOT_DRAWN = 32
MAX_HOT = 50_000
# Kinds of packed rows.
OPEN, ANSWERED, HOT = 0, 1, 2
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hasher:
    """Polynomial hashes modulo 2**64 of all stretches of a text, through prefix sums."""

    def __init__(self, which: int):
        rng = np.random.default_rng(which + 1)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        base = MULTIPLIERS[which]
        size = BLOCK_BYTES + WIDTH + 1
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, dtype=np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([
            [np.uint64(1)], np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        ]))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(self.values[codes] * self.powers[:len(codes)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.inverse[start]
        x += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(x)

    def all(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mixed((sums[width:] - sums[:-width]) * self.inverse[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def blocks(text: bytes, width: int):
    """(offset, bytes) parts that together hold every window once."""
    for at in range(0, max(1, len(text) - width + 1), BLOCK_BYTES):
        yield at, np.frombuffer(text, dtype=np.uint8)[at:at + BLOCK_BYTES + width - 1]


def run_blocks(text: bytes, hasher: Hasher, width: int):
    """Per block the number of runs before it, and its runs of windows with one anchor: first
    window, last window, anchor hash, string hash."""
    n = 0
    for offset, codes in blocks(text, width):
        if len(codes) < width:
            continue
        sums = hasher.sums(codes)
        grams = hasher.all(sums, GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~np.uint64(0xFFFFFF)) | place, width - GRAM + 1)
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        yield n, first + offset, last + offset, grams[anchor[first]], hasher.stretch(sums, first, last + width)
        n += len(first)


def together(parts: list, dtypes) -> tuple:
    return tuple(np.concatenate([np.zeros(0, dtype=t), *c]) for t, c in zip(dtypes, zip(*parts) if parts else [()] * len(dtypes)))


def chosen_runs(text: bytes, hasher: Hasher, width: int, places: np.ndarray) -> tuple:
    """First windows, last windows, anchors and strings of the runs at ascending ``places``."""
    found = []
    for n, *columns in run_blocks(text, hasher, width):
        here = places[slice(*np.searchsorted(places, [n, n + len(columns[0])]))] - n
        found.append([c[here] for c in columns])
    return together(found, (np.int64, np.int64, np.uint64, np.uint64))


def distinct_runs(text: bytes, hasher: Hasher, width: int) -> tuple:
    """Anchors, strings and places of a text's runs, of equal ones in a block the first, marked."""
    found = []
    for n, _, _, a, b in run_blocks(text, hasher, width):
        order = np.lexsort((b, a))
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        more = np.zeros(len(a), dtype=np.int64)
        more[:-1] = np.where(fresh[1:], 0, AGAIN)
        kept = order[fresh]
        found.append((a[kept], b[kept], kept + n | more[fresh]))
    return together(found, (np.uint64, np.uint64, np.int64))


def among(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) are among some."""
    order = np.lexsort((some_b, some_a))
    some_a, some_b = some_a[order], some_b[order]
    low, high = np.searchsorted(some_a, a, "left"), np.searchsorted(some_a, a, "right")
    found = np.zeros(len(a), dtype=bool)
    for step in range(int((high - low).max(initial=0))):
        at = np.minimum(low + step, len(some_b) - 1)
        found |= (low + step < high) & (some_b[at] == b)
    return found


PACKED = "bucket int, kind int, a binary, b binary, place binary, of binary, docs binary, keys binary"
ANSWER = "doc bigint, key bigint, place bigint, kind int"


def dealt(a, b, place, of, docs, keys, n_buckets: int, hot=None):
    """Entries of a slice as packed rows per bucket; entries answered within the slice apart.

    ``of`` tells the document of an entry as a position in ``docs`` and ``keys``; ``hot``
    holds the anchors that are dealt by both digits, ascending.
    """
    rank = np.empty(len(docs), dtype=np.int64)
    rank[np.argsort(docs, kind="stable")] = np.arange(len(docs))
    order = np.lexsort((rank[of], b, a))
    a, b, place, of = a[order], b[order], place[order], of[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    own = fresh.copy()
    own[1:] |= of[1:] != of[:-1]
    place[:-1] |= np.where(own[1:], 0, AGAIN)
    a, b, place, of, fresh = a[own], b[own], place[own], of[own], fresh[own]
    owner = docs[of]
    least = owner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    known = owner > least
    out = [[] for _ in range(8)]

    def add(bucket, kind, rows):
        used, local = np.unique(of[rows], return_inverse=True)
        for column, value in zip(out, (
            bucket, kind, a[rows].tobytes() if kind != ANSWERED else b"", b[rows].tobytes() if kind != ANSWERED else b"",
            place[rows].astype("<u4").tobytes(), local.astype("<u4").tobytes(),
            docs[used].tobytes(), keys[used].astype("<i4").tobytes(),
        )):
            column.append(value)

    is_hot = np.isin(a, hot) if hot is not None and len(hot) else np.zeros(len(a), dtype=bool)
    # Anchors are least hashes, most of them small numbers: mixed, they fill buckets evenly.
    digit = mixed(a ^ np.where(is_hot, b * np.uint64(MULTIPLIERS[0]), np.uint64(0)))
    # An even number for a bucket's ordinary entries, the next one for its hot ones.
    to = ((digit >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64) * 2 + is_hot
    # Every bucket is one stretch; inside it entries go by document to pack well.
    open_rows = np.flatnonzero(~known)
    open_rows = open_rows[np.argsort(to[open_rows], kind="stable")]
    for part in np.split(open_rows, np.flatnonzero(np.diff(to[open_rows])) + 1) if len(open_rows) else ():
        bucket, its_kind = divmod(int(to[part[0]]), 2)
        add(bucket, HOT if its_kind else OPEN, part[np.lexsort((place[part], of[part]))])
    answered = np.flatnonzero(known)
    if len(answered):
        answered = answered[np.lexsort((place[answered], of[answered]))]
        add(int(keys[of[answered[0]]] % n_buckets), ANSWERED, answered)
    return out


def sort_bucket(table: pa.Table, first_kind: int, with_parts: bool) -> pa.Table:
    """Answers of one bucket: entries of strings that a smaller document has, and with
    ``with_parts`` one entry of each different string that shares its anchor with another.

    Strings of a hot anchor are in many buckets, so each of them goes on."""
    columns = {n: table.column(n).to_pylist() for n in table.schema.names}

    def joined(name, kinds, dtype):
        return np.concatenate([np.zeros(0, dtype=dtype)] + [
            np.frombuffer(x, dtype=dtype) for x, k in zip(columns[name], columns["kind"]) if k in kinds
        ])

    def owners(kinds):
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for of, d, k, row_kind in zip(columns["of"], columns["docs"], columns["keys"], columns["kind"]):
            if row_kind in kinds:
                at = np.frombuffer(of, dtype="<u4")
                docs.append(np.frombuffer(d, dtype="<i8")[at])
                keys.append(np.frombuffer(k, dtype="<i4")[at].astype(np.int64))
        return np.concatenate(docs), np.concatenate(keys)

    docs1, keys1 = owners([ANSWERED])
    place1 = joined("place", [ANSWERED], "<u4")
    still = [OPEN, HOT]
    a, b, place = joined("a", still, "<u8"), joined("b", still, "<u8"), joined("place", still, "<u4")
    hot = np.concatenate([np.zeros(0, dtype=bool)] + [
        np.full(len(x) // 4, k == HOT) for x, k in zip(columns["place"], columns["kind"]) if k in still
    ])
    docs, keys = owners(still)
    order = np.lexsort((docs, b, a))
    a, b, place, hot, docs, keys = a[order], b[order], place[order], hot[order], docs[order], keys[order]
    new_a = np.ones(len(a), dtype=bool)
    new_a[1:] = a[1:] != a[:-1]
    new_b = new_a.copy()
    new_b[1:] |= b[1:] != b[:-1]
    least = docs[np.flatnonzero(new_b)[np.cumsum(new_b) - 1]] if len(a) else docs
    whole = docs > least
    rows, kinds = [np.flatnonzero(whole)], [np.full(int(whole.sum()), first_kind)]
    if with_parts and len(a):
        group = np.cumsum(new_a) - 1
        starts = np.flatnonzero(new_a)
        strings = np.add.reduceat(new_b.astype(np.int64), starts)
        several = (strings > 1) & (np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts))
        part = (several[group] | hot) & ~whole
        rows.append(np.flatnonzero(part))
        kinds.append(np.full(int(part.sum()), PART))
    at = np.concatenate(rows)
    return pa.table({
        "doc": np.concatenate([docs1, docs[at]]), "key": np.concatenate([keys1, keys[at]]),
        "place": np.concatenate([place1, place[at]]).astype(np.int64),
        "kind": np.concatenate([np.full(len(docs1), first_kind), *kinds]).astype(np.int32),
    })


def answers(entries: DataFrame, first_kind: int, with_parts: bool, name: str) -> DataFrame:
    """The stored answers of all buckets."""
    found = entries.groupBy("bucket").applyInArrow(
        lambda table: sort_bucket(table, first_kind, with_parts), ANSWER
    )
    with small_batches(entries.sparkSession):
        return materialise(found, name)


def release(spark) -> None:
    """Let Spark delete the shuffle files of passes that nothing refers to any more.

    The session keeps hold of its last query, so a small one takes that place first; the
    files go in the background, shortly after the collection.
    """
    spark.range(1).collect()
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def entries_of(batch, hasher: Hasher, width: int) -> tuple:
    """Of a slice's runs the anchors, strings, places, documents as positions, and the documents."""
    docs = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
    keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [distinct_runs(t, hasher, width) for t in raw(batch)]
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return *[np.concatenate(c) for c in zip(*parts)], of, docs, keys


def hot_anchors(keyed: DataFrame, width: int) -> np.ndarray:
    """Anchors with very many different strings, from one string in DRAWN_OF."""
    def start():
        hasher = Hasher(0)

        def step(batch):
            a, b, *_ = entries_of(batch, hasher, width)
            drawn = b % np.uint64(DRAWN_OF) == 0
            pairs = np.unique(np.stack([a[drawn], b[drawn]], axis=1), axis=0).view(np.int64)
            return [pairs[:, 0], pairs[:, 1]] if len(pairs) else None

        return step

    drawn = emit(keyed, start, "a bigint, b bigint", SLICE_BYTES)
    counted = drawn.groupBy("a").agg(F.count_distinct("b").alias("n")).where(F.col("n") >= HOT_DRAWN)
    found = counted.orderBy(F.desc("n"), "a").limit(MAX_HOT).collect()
    return np.sort(np.array([r["a"] for r in found], dtype=np.int64).view(np.uint64))


def run_entries(keyed: DataFrame, width: int, n_buckets: int, hot: np.ndarray | None = None) -> DataFrame:
    def start():
        hasher = Hasher(0)
        return lambda batch: dealt(*entries_of(batch, hasher, width), n_buckets, hot)

    return emit(keyed, start, PACKED, SLICE_BYTES)


def window_entries(joined: DataFrame, width: int, n_buckets: int) -> DataFrame:
    def start():
        hashers = Hasher(0), Hasher(1)

        def windows(text, places):
            at = np.unique(places % AGAIN)
            first, last, _, _ = chosen_runs(text, hashers[0], width, at)
            sizes = last - first + 1
            starts = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            out = [np.zeros(len(starts), dtype=np.uint64) for _ in hashers]
            for offset, codes in blocks(text, width):
                here = (starts >= offset) & (starts < offset + BLOCK_BYTES)
                for column, hasher in zip(out, hashers):
                    local = starts[here] - offset
                    column[here] = hasher.stretch(hasher.sums(codes), local, local + width)
            # What a run that comes again holds comes again.
            return starts | np.repeat(np.isin(at, places[places >= AGAIN] % AGAIN), sizes) * AGAIN, *out

        def step(batch):
            docs = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [windows(t, np.array(p)) for t, p in zip(raw(batch), batch.column("places").to_pylist())]
            sizes = [len(p[0]) for p in parts]
            return dealt(
                np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]),
                np.concatenate([p[0] for p in parts]), np.repeat(np.arange(len(parts)), sizes),
                docs, keys, n_buckets,
            )

        return step

    return emit(joined.select("doc", "key", "text", "places"), start, PACKED, SLICE_BYTES)


def removed_spans(
    text: bytes, answered: list[tuple[int, int]], hashers: tuple[Hasher, Hasher], width: int
) -> list[tuple[int, int]]:
    """Disjoint byte spans that the answered runs and windows cover, wherever the text has them."""
    change = np.zeros(len(text) + 1, dtype=np.int64)

    def cover(first, last):
        np.add.at(change, first, 1)
        np.add.at(change, last + width, -1)

    def places_of(wanted):
        marked = np.sort(np.array([p for kind, p in answered if kind == wanted], dtype=np.int64))
        return np.unique(marked % AGAIN), np.unique(marked[marked >= AGAIN] % AGAIN)

    whole, again = places_of(WHOLE)
    if len(whole):
        first, last, a, b = chosen_runs(text, hashers[0], width, whole)
        cover(first, last)
        if len(again):
            some = np.isin(whole, again)
            for _, first, last, at_a, at_b in run_blocks(text, hashers[0], width):
                same = among(at_a, at_b, a[some], b[some])
                cover(first[same], last[same])
    single, again = places_of(WINDOW)
    cover(single, single)
    if len(again):
        def hashes():
            for offset, codes in blocks(text, width):
                yield offset, *[h.all(h.sums(codes), width) for h in hashers]

        some = together([
            [h[again[slice(*np.searchsorted(again, [offset, offset + len(h)]))] - offset] for h in both]
            for offset, *both in hashes()
        ], (np.uint64, np.uint64))
        for offset, *both in hashes():
            same = np.flatnonzero(among(*both, *some)) + offset
            cover(same, same)
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(covered))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def remove_repeats(docs: DataFrame, carry=None, width: int = WIDTH) -> DataFrame:
    """``doc`` with ``n_bytes``, ``spans`` (start, end in bytes) and ``kept``, the bytes that stay.

    A byte goes when a string of ``width`` bytes over it also starts in a document with a
    smaller doc_id; strings are judged on the input. A missing text counts as empty. A
    missing doc_id counts as larger than any other; rows with equal ids are no partners of
    one another, and rows equal in id and text get the same answer. An empty table gives
    an empty result.

    Documents are told apart by id and, under one id, a hash of the text, which every scan
    finds again.
    Texts are read four times and shuffled twice, to meet the answers; each pass's shuffle
    files are released before the next.
    """
    spark = docs.sparkSession
    packed = pack(docs, carry, "doc_id").select(
        "doc", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("no"),
    )
    keyed = packed.select("doc", "text", "no", F.hash("text").cast("bigint").alias("key"))
    light = keyed.select(F.col("no").alias("doc"), "key", "text")
    size = light.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n_buckets = max(1, int(size * 2 / (width - GRAM + 2) / BUCKET_ENTRIES) + 1)

    # One bucket needs no dealing.
    hot = hot_anchors(light, width) if n_buckets > 1 else None
    first = answers(run_entries(light, width, n_buckets, hot), WHOLE, True, "runs")
    release(spark)
    partial = first.where(F.col("kind") == PART).groupBy("doc", "key").agg(F.collect_set("place").alias("places"))
    left_over = first.where(F.col("kind") == PART).count()
    more_buckets = max(1, int(left_over * (width - GRAM + 2) / 2 / BUCKET_ENTRIES) + 1)
    second = answers(
        window_entries(light.join(partial, ["doc", "key"]), width, more_buckets), WINDOW, False, "windows"
    )
    release(spark)
    answered = first.where(F.col("kind") == WHOLE).unionByName(second).groupBy("doc", "key").agg(
        F.collect_set(F.struct("kind", "place")).alias("answered")
    ).select(F.col("doc").alias("no"), "key", "answered")

    def start():
        hashers = Hasher(0), Hasher(1)

        def step(batch):
            texts = raw(batch)
            spans = [
                removed_spans(t, [(x["kind"], x["place"]) for x in found], hashers, width) if found else []
                for t, found in zip(texts, batch.column("answered").to_pylist())
            ]
            return [len(t) for t in texts], spans, [without(t, s) for t, s in zip(texts, spans)]

        return step

    met = keyed.join(answered, ["no", "key"], "left").select("doc", "text", "answered")
    return append(met, start, "n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary").drop(
        "text", "answered"
    )


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    return b"".join(text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)]))


def op4_remove_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])
    return found.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


# Windows as text in hexadecimal digits, two a byte.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
windows AS (
    SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS g
    FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM sized WHERE n >= 50)
), hits AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows)
    WHERE doc_id > first
), marked AS (
    SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS opens FROM hits
), numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY ALL),
gaps AS (
    SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS free FROM spans
), kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * free - 1, 2 * (a - free)), '' ORDER BY a) AS front,
           max(z) AS last, count(*) AS n_spans, sum(z - a) AS n_removed
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT sized.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM sized LEFT JOIN kept USING (doc_id)
"""

ship(__name__)
