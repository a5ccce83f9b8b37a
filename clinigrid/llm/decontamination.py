"""Benchmark decontamination with a generalised suffix automaton over item words.

The items become one automaton (in blocks of a bounded size); each document's words run
through it, and the longest matching length at every word tells which words lie in a
window of an item.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinigrid.llm.common import append, documents, emit, pack, raw, sha256_of_list, ship, with_text
from clinigrid.session import drop_stage, materialise, write_stage

WINDOW_WORDS = 13
# A document is contaminated when this share of its words is hit.
MAX_COVERAGE_PERCENT = 5
# An automaton holds at most this many words (about 60 MB in a task); more items make more blocks.
BLOCK_WORDS = 100_000
# Longer items enter in overlapping pieces, which have the same windows.
PIECE_WORDS = 20_000
# Longer texts are split into words in parts.
PART_BYTES = 4 << 20
# Words of lower-cased text: everything that is no ASCII sign or space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SIGN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
# Never part of a UTF-8 text; parts documents from one another.
MARK = b"\xff"
HASH_BITS = 20


class Automaton:
    """Generalised suffix automaton of (item, short, words) pieces.

    ``short`` items, of fewer words than a window, count only as a whole.
    """

    def __init__(self, pieces, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {MARK: -1}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = []
        for item, short, words in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, short, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: dict[int, set] = {}
        self.whole: dict[int, list] = {}
        for item, short, ids in coded:
            state = 0
            for at, c in enumerate(ids):
                state = self.next[state][c]
                if not short and at + 1 >= window:
                    self.items.setdefault(self._window_state(state), set()).add(item)
            if short:
                self.whole.setdefault(state, []).append((len(ids), item))
        self.shortest = min([window, *[len(ids) for _, short, ids in coded if short]])
        self.base = len(self.vocabulary) + 1
        self.pairs = np.zeros(1 << HASH_BITS, dtype=bool)
        for _, _, ids in coded:
            one = np.array(ids, dtype=np.int64)
            self.pairs[self._pair_hash(one[:-1], one[1:])] = True

    def _extend(self, last: int, c: int) -> int:
        length, link, following = self.length, self.link, self.next
        known = following[last].get(c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, c, known)
        fresh = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = fresh
            p = link[p]
        if p >= 0:
            q = following[p][c]
            link[fresh] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return fresh

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _pair_hash(self, a, b):
        x = a * self.base + b
        return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches that may hold a window: known words whose pairs all occur in items."""
        if not len(ids):
            return
        known = ids > 0
        linked = known[:-1] & known[1:]
        at = np.flatnonzero(linked)
        linked[at] = self.pairs[self._pair_hash(ids[at], ids[at + 1])]
        first = np.flatnonzero(known & ~np.concatenate([[False], linked]))
        end = np.flatnonzero(known & ~np.concatenate([linked, [False]])) + 1
        long = end - first >= self.shortest
        yield from zip(first[long].tolist(), end[long].tolist())

    def match(self, ids: list[int], offset: int, spans: list, items: set) -> None:
        """Walk one run; append [start, end) of hits in word positions, and add hit items."""
        state = matched = 0
        for at, c in enumerate(ids, offset):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            if matched >= self.window:
                spans.append((at + 1 - matched, at + 1))
                items |= self.items[self._window_state(state)]
            if self.whole:
                up = state
                while up > 0:
                    for n, item in self.whole.get(up, ()):
                        if n <= matched:
                            spans.append((at + 1 - n, at + 1))
                            items.add(item)
                    up = self.link[up]


def merged(spans) -> list[int]:
    """Sorted, disjoint, non-touching spans as one flat list."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def parts(text: bytes) -> Iterator[bytes]:
    """The text cut between words into parts of about PART_BYTES."""
    at = 0
    while len(text) - at > PART_BYTES:
        cut = SIGN.search(text, at + PART_BYTES)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def scan(automaton: Automaton, texts: list[bytes]) -> tuple[list, list, list]:
    """Per text the number of words, the spans and the items."""
    get = automaton.vocabulary.get
    counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    short = [i for i, t in enumerate(texts) if len(t) <= PART_BYTES]
    words = (b" " + MARK + b" ").join([texts[i] for i in short]).translate(FOLD).split()
    ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    del words
    marks = np.flatnonzero(ids == -1)
    edges = [-1, *marks.tolist(), len(ids)]
    for n, i in enumerate(short):
        counts[i] = edges[n + 1] - edges[n] - 1
    starts = np.array(edges[:-1]) + 1
    for first, end in automaton.runs(ids):
        n = int(np.searchsorted(starts, first, side="right")) - 1
        automaton.match(ids[first:end].tolist(), first - int(starts[n]), spans[short[n]], items[short[n]])
    for i, text in enumerate(texts):
        if len(text) > PART_BYTES:
            tail = np.zeros(0, dtype=np.int64)
            for part in parts(text):
                words = part.translate(FOLD).split()
                # A window across a cut lies whole in the next part with the last words before it.
                ids = np.concatenate([tail, np.fromiter(map(get, words, repeat(0)), np.int64, len(words))])
                for first, end in automaton.runs(ids):
                    automaton.match(
                        ids[first:end].tolist(), counts[i] - len(tail) + first, spans[i], items[i]
                    )
                counts[i] += len(words)
                tail = ids[max(0, len(ids) - automaton.window + 1):]
    return counts, [merged(s) for s in spans], items


def blocks(benchmark: DataFrame, window: int) -> tuple[DataFrame, int]:
    """The items' words as a stored table (item_id, short, words, n, block), and how many blocks it has.

    Pieces are packed by running word counts, within a part of the table and then over
    parts, so a block holds ``BLOCK_WORDS`` and at most one more piece.
    """
    def start():
        def step(batch):
            out = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), raw(batch)):
                words = text.translate(FOLD).split()
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    if words:
                        part = words[at:at + PIECE_WORDS + window - 1]
                        for column, value in zip(out, (item, len(words) < window, b" ".join(part), len(part))):
                            column.append(value)
            return out

        return step

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string"))
    pieces = materialise(
        emit(items, start, "item_id string, short boolean, words binary, n bigint").withColumns(
            {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
        ), "pieces",
    )
    kept = "item_id", "short", "words", "n"
    if (pieces.agg(F.sum("n")).first()[0] or 0) <= BLOCK_WORDS:
        return pieces.select(*kept, F.lit(0).cast("bigint").alias("block")), 1
    rows = Window.unboundedPreceding, -1
    parts = pieces.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*rows)), F.lit(0)).alias("before"),
    )
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(*rows)), F.lit(0))
    packed = pieces.withColumn("within", within).join(parts, "part").select(
        *kept, F.floor((F.col("before") + F.col("within")) / BLOCK_WORDS).alias("block")
    )
    stored = materialise(packed, "blocks")
    return stored, stored.agg(F.max("block")).first()[0] + 1


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, carry=None, window: int = WINDOW_WORDS,
    max_coverage_percent: float = MAX_COVERAGE_PERCENT, clean: bool = False,
) -> DataFrame:
    """Per document ``n_words``, ``n_hit``, ``spans`` (word positions), ``items``, ``contaminated``.

    A word is hit when it lies in ``window`` consecutive words of an item, or in a whole
    item of fewer; a document is contaminated when its hits reach ``max_coverage_percent``
    of its words. With ``clean``, ``clean_text`` is the text without its hit spans.
    Missing texts have no words; items without words or an id are never met, respectively
    counted under no name; repeated items count once. Documents pass every block of items
    in turn, without a shuffle. The driver and a task hold one block at a time: documents
    are written between passes, and a pass's table goes when the next is written.
    """
    spark = docs.sparkSession
    found = pack(docs, carry).withColumns({
        "n_words": F.lit(0).cast("bigint"), "spans": F.array().cast("array<int>"),
        "items": F.array().cast("array<string>"),
    })
    stored, n_blocks = blocks(benchmark, window)
    path = None
    for block in range(n_blocks):
        pieces = stored.where(F.col("block") == block).select("item_id", "short", "words").collect()
        held = spark.sparkContext.broadcast([(r["item_id"], r["short"], bytes(r["words"]).split()) for r in pieces])

        def start(held=held):
            automaton = Automaton(held.value, window)

            def step(batch):
                counts, spans, items = scan(automaton, raw(batch))
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                both = [
                    (merged([*zip(old[::2], old[1::2]), *zip(new[::2], new[1::2])]) if old else new,
                     sorted({*named, *more} - {None}))
                    for (old, named), new, more in zip(before, spans, items)
                ]
                return counts, [b[0] for b in both], [b[1] for b in both]

            return step

        found = append(found, start, "new_words bigint, new_spans array<int>, new_items array<string>")
        found = found.select(
            "doc", "text", F.col("new_words").alias("n_words"), F.col("new_spans").alias("spans"),
            F.col("new_items").alias("items"),
        )
        if block < n_blocks - 1:
            found, written = write_stage(found, "hits")
            drop_stage(spark, path)
            held.destroy()
            path = written
    if clean:
        def start_clean():
            return lambda batch: [[
                without(t, s) if s else t
                for t, s in zip(raw(batch), batch.column("spans").to_pylist())
            ]]

        found = append(found, start_clean, "cleaned binary").withColumn(
            "clean_text", F.when(F.size("spans") > 0, F.col("cleaned").cast("string")).otherwise(F.col("text"))
        ).drop("cleaned")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: x.cast("bigint") - a)
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated",
        (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= max_coverage_percent * F.col("n_words")),
    )


def without(text: bytes, spans: list[int]) -> bytes:
    """The text without the spans of words, each cut from its first to its last word."""
    wanted = iter(spans)
    edge, kept, at = next(wanted), [], 0
    inside = False
    end = 0
    for n, word in enumerate(WORD.finditer(text)):
        while edge is not None and n == edge:
            if inside:
                at = end
            else:
                kept.append(text[at:word.start()])
            inside = not inside
            edge = next(wanted, None)
        end = word.end()
    kept.append(b"" if inside else text[at:])
    if inside:
        kept.append(text[end:])
    return b"".join(kept)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; hit spans are cut from the others."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark, clean=True)
    return with_text(found.where(~F.col("contaminated")), "clean_text")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(
        documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
        carry=["doc_id"],
    )
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        sha256_of_list("items").alias("items_sha256"), "contaminated",
    )


OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT k, item_id, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT k, item_id, w, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), places AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
          FROM d CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (SELECT doc_id, k, i, item_id FROM places JOIN windows USING (k, g)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ship(__name__)
