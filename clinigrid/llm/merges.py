"""SentencePiece encoding by the merges of a model of the BPE type.

From single characters on, the two neighbours that make the piece of the highest score
become one, the leftmost of equals first, until no two neighbours make a piece. No merge
crosses two characters that stand next to each other in no piece, so texts are cut between
such characters, in front of spaces for one, and what lies between two cuts is encoded
apart: words for ordinary documents, chunks of many words for giant ones.
"""

from __future__ import annotations

from array import array
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, emit, pack, ship
from clinigrid.llm.pieces import (
    CHUNK_CHARS, CUT_SEARCH, GIANT_CHARS, MODEL_PATH, SPACE, Pieces, id_lists, model_bytes, pieces_of,
)
from clinigrid.session import materialise

# Two neighbours that make no piece.
APART = (1 << 31) - 1
# Longer stretches without a cut are merged through a heap.
SHORT = 100


def merge_vocabulary(model: bytes) -> tuple:
    """What ``Merges`` needs of a model, as plain values: made once, sent to every task."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    read = pb.ModelProto()
    read.ParseFromString(model)
    if read.trainer_spec.model_type != pb.TrainerSpec.BPE:
        raise ValueError("the model is not of the BPE type")
    normalizer = read.normalizer_spec
    if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not (
        normalizer.add_dummy_prefix and normalizer.escape_whitespaces
    ):
        raise ValueError("the model changes texts before it encodes them, or puts no space in front")
    kinds = pb.ModelProto.SentencePiece
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in read.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    pieces, byte_ids, surface = pieces_of(model)
    for piece in pieces:
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} crosses the front of a space")
    return pieces, byte_ids, surface, 0.0, "" if any("\n" in p for p in pieces) else "\n"


class Merges(Pieces):
    """A vocabulary of the BPE type, with a cache of encoded words."""

    def __init__(self, known: tuple):
        super().__init__(known)
        order = {s: n for n, s in enumerate(sorted({s for s, _ in self.pieces.values()}, reverse=True))}
        self.rank = {p: order[s] for p, (s, _) in self.pieces.items()}
        self.inside = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}

    def path(self, text: str) -> tuple[None, list[int]]:
        """The ids of a text that has spaces as in the vocabulary."""
        ids: list[int] = []
        start, size, inside = 0, len(text), self.inside
        for end in range(1, size + 1):
            if end == size or text[end - 1:end + 1] not in inside:
                for part in self.merged(text[start:end]):
                    found = self.pieces.get(part)
                    ids += [found[1]] if found else [self.byte_ids[b] for b in part.encode()]
                start = end
        return None, ids

    def merged(self, text: str) -> list[str]:
        if len(text) > SHORT:
            return self.merged_by_heap(text)
        parts, rank = list(text), self.rank.get
        pairs = [rank(a + b, APART) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == APART:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], APART)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], APART)
        return parts

    def merged_by_heap(self, text: str) -> list[str]:
        size, rank = len(text), self.rank.get
        parts: list = list(text)
        after, before = array("i", range(1, size + 1)), array("i", range(-1, size - 1))
        # By the start of the left neighbour; a heap entry whose rank is no longer there is void.
        pairs = array("i", [rank(text[i:i + 2], APART) for i in range(size - 1)] + [APART])
        heap = [r << 32 | i for i, r in enumerate(pairs) if r != APART]
        heapify(heap)

        def look(i):
            pairs[i] = rank(parts[i] + parts[after[i]], APART) if after[i] < size else APART
            if pairs[i] != APART:
                heappush(heap, pairs[i] << 32 | i)

        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pairs[i] != top >> 32:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j], pairs[j] = None, APART
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [p for p in parts if p is not None]

    def chunks(self, text: str, chars: int = CHUNK_CHARS, search: int = CUT_SEARCH) -> list[str]:
        """Parts of a text between cuts, of about ``chars`` characters, or as many as have no cut.

        Spaces are still spaces.
        """
        def crossed(at):
            return text[at - 1:at + 1].replace(" ", SPACE) in self.inside

        out, at = [], 0
        while len(text) - at >= 2 * chars:
            end = at + chars
            while end > max(at, at + chars - search) and crossed(end):
                end -= 1
            if end <= at or crossed(end):
                end = at + chars
                while end < len(text) and crossed(end):
                    end += 1
            out.append(text[at:end])
            at = end
        return [*out, text[at:]] if at < len(text) else out


def _giant_ids(giants: DataFrame, model, chunk_chars: int) -> DataFrame:
    """(doc, text, ids) of giant documents, through chunks."""
    # Stored, since the numbers of rows have to stay the same.
    rows = materialise(giants.withColumn("row", F.monotonically_increasing_id()), "giants")

    def start_split():
        pieces = Merges(model.value)

        def step(batch):
            cut = [
                (row, no, part)
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())
                for no, part in enumerate(pieces.chunks(" " + text.replace(SPACE, " "), chunk_chars))
            ]
            return list(zip(*cut))

        return step

    parts = materialise(emit(rows.select("row", "text"), start_split, "row bigint, no int, part string"), "chunks")

    def start_encode():
        pieces = Merges(model.value)
        return lambda batch: [pieces.encode(batch.column("part").to_pylist())]

    def joined(key, frame):
        import pandas as pd

        return pd.DataFrame({"row": [key[0]], "packed": [b"".join(frame.sort_values("no")["packed"])]})

    encoded = append(parts, start_encode, "packed binary").select("row", "no", "packed")
    whole = encoded.groupBy("row").applyInPandas(joined, "row bigint, packed binary")
    ids = append(whole, lambda: lambda batch: [id_lists(batch.column("packed").to_pylist())], "ids array<int>")
    return rows.join(ids.select("row", "ids"), "row").select("doc", "text", "ids")


def encode_merges(
    docs: DataFrame, carry=None, model_path: str = MODEL_PATH, giant_chars: int = GIANT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``doc`` and ``text`` of every document with ``ids`` and ``n_pieces``, as SentencePiece encodes it.

    A space is put in front of a text that is not empty; a character without a piece
    becomes its bytes. Missing and empty texts have no pieces. Rows are encoded one by
    one, so repeated rows and empty tables need no rule. A stretch that has no cut is
    merged in one task, whatever its length.
    """
    model = docs.sparkSession.sparkContext.broadcast(merge_vocabulary(model_bytes(model_path)))
    packed = pack(docs, carry)

    def start():
        pieces = Merges(model.value)
        return lambda batch: [id_lists(pieces.encode([
            " " + t if t else "" for t in batch.column("text").to_pylist()
        ]))]

    giant = F.coalesce(F.length("text"), F.lit(0)) > giant_chars
    ordinary = append(packed.where(~giant), start, "ids array<int>")
    found = ordinary.unionByName(_giant_ids(packed.where(giant), model, chunk_chars))
    return found.withColumn("n_pieces", F.size("ids").cast("bigint"))


ship(__name__)
