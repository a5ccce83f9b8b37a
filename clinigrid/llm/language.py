"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its three letters, each
rotated by its place, by multiplication; a text bundles its trigrams by addition. A
language's prototype bundles all its training texts, and a text gets the language whose
prototype has the largest cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, documents, emit, ship

DIMENSIONS = 1024
SEED = 11
# Trigram vectors that a task remembers (1 KB each); beyond it starts again.
KEPT_TRIGRAMS = 40_000
# More learned languages than this are refused: prototypes go to every task (8 KB each).
MAX_LANGUAGES = 4096
# Of a longer text this many characters are counted at once.
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"


def held_out(doc_id) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2; a missing id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Hypervectors:
    """Trigrams of texts and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), dtype=np.int8)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of letters, words parted by single spaces, with counts.

        A long text is read block by block; the two signs before a block stay, so the
        blocks together count what the whole text would.
        """
        low = text.lower()
        found: dict[int, int] = {}
        one = None
        # A space stands in front of a text and behind it.
        before, after_letter = np.array([32]), False
        for at in range(0, max(1, len(low)), BLOCK_CHARS):
            part = low[at:at + BLOCK_CHARS]
            if at + BLOCK_CHARS >= len(low):
                part += " "
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
            is_letter = self.letter[codes]
            # Of signs that are no letters the first counts, as a space.
            keep = is_letter | np.concatenate([[after_letter], is_letter[:-1]])
            codes = np.concatenate([before, np.where(is_letter, codes, 32)[keep]])
            before, after_letter = codes[-2:], bool(is_letter[-1])
            keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
            one = np.unique(keys[codes[1:-1] != 32], return_counts=True)
            if len(low) > BLOCK_CHARS:
                for k, n in zip(*(x.tolist() for x in one)):
                    found[k] = found.get(k, 0) + n
        if len(low) > BLOCK_CHARS:
            # In the order of a text that is not cut.
            keys = np.array(sorted(found), dtype=np.int64)
            return keys, np.array([found[k] for k in keys.tolist()], dtype=np.int64)
        return one

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            rng = np.random.default_rng([self.seed, code])
            self.letters[code] = (rng.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def _row(self, key: int) -> int:
        row = self.rows.get(key)
        if row is None:
            row = len(self.rows)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            mask = (1 << 21) - 1
            self.table[row] = (
                np.roll(self._letter(key >> 42), 2) * np.roll(self._letter(key >> 21 & mask), 1)
                * self._letter(key & mask)
            )
            self.rows[key] = row
        return row

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for at in range(0, len(keys), 4096):
            if len(self.rows) > KEPT_TRIGRAMS:
                self.rows.clear()
            rows = [self._row(k) for k in keys[at:at + 4096].tolist()]
            total += counts[at:at + 4096].astype(np.float32) @ self.table[rows].astype(np.float32)
        return total


def prototypes(training: DataFrame) -> dict[str, np.ndarray]:
    """Centred unit prototypes by language, from (lang, text) rows; empty without any.

    Every text counts alike, however long. Sums of vectors are made per slice of a task and added by Spark; what reaches the
    driver is DIMENSIONS numbers a language.
    """
    def start():
        space = Hypervectors()

        def step(batch):
            found: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                keys, counts = space.trigrams(text)
                if len(keys):
                    found.setdefault(lang, []).append((keys, counts / counts.sum()))
            vectors = []
            for parts in found.values():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                vectors.append(space.bundle(keys, np.bincount(place, np.concatenate([w for _, w in parts]))).tolist())
            return list(found), vectors

        return step

    partial = emit(training.where("lang is not null and text is not null"), start, "lang string, vector array<double>")
    sums = partial.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).toLocalIterator():
        if len(found) == MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        found[row["lang"]] = np.array([c["x"] for c in row["v"]])
    found = {lang: v / n for lang, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}
    if len(found) > 1:
        middle = np.mean(list(found.values()), axis=0)
        found = {lang: v - middle for lang, v in found.items()}
    return {lang: v / max(np.linalg.norm(v), 1e-12) for lang, v in found.items()}


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, (1 + cosine) / 2.

    ``und`` with score 0 where the text is missing or has no letter, or nothing was
    learned; equal cosines go to the first language by name. Each row stands by itself.
    """
    held = docs.sparkSession.sparkContext.broadcast(
        (list(learned), np.array(list(learned.values())).reshape(len(learned), DIMENSIONS))
    )

    def start():
        names, matrix = held.value
        space = Hypervectors()

        def one(text):
            keys, counts = space.trigrams(text or "")
            if not names or not len(keys):
                return UNKNOWN, 0.0
            vector = space.bundle(keys, counts)
            cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
            best = int(np.argmax(cosines))
            return names[best], min(1.0, max(0.0, (1 + float(cosines[best])) / 2))

        return lambda batch: list(zip(*[one(t) for t in batch.column("text").to_pylist()]))

    return append(docs, start, "lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "lang", "text").withColumn("held_out", held_out("doc_id"))
    learned = prototypes(docs.where(~F.col("held_out")).select("lang", "text"))
    return identify(docs.select("doc_id", "held_out", "text"), learned).drop("text")


ship(__name__)
