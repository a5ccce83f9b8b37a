"""SentencePiece unigram encoding by a max-plus parallel scan, decoding, and the query.

The query and the pipeline encode through the lattice of ``clinigrid.llm.lattice``, as the
given model is of the BPE type; ``encode`` is for models whose scores are log probabilities.

The best segmentation of a text maximises the sum of its pieces' scores. A text decomposes
where no useful piece crosses, in front of spaces and around characters that no piece has;
ordinary documents are encoded between such cuts. Giant documents become chunks. Every
chunk yields a transfer matrix in the max-plus semiring, from how far a piece reaches into
it to how far one reaches out of it; an associative scan of the matrices fixes the state at
every boundary, and each chunk is traced back on its own.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import MAX_BROADCAST_BYTES, append, documents, emit, pack, ship
from clinigrid.session import materialise

MODEL_PATH = os.environ.get("TOKENIZER_PATH", "/opt/tokenizers") + "/piece_bpe_32k.model"
SPACE = "▁"
# Texts of more characters are encoded in chunks.
GIANT_CHARS = 65_536
CHUNK_CHARS = 32_768
# How far back from a chunk's end a cut is looked for.
CUT_SEARCH = 2_048
# Fixed value: what an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
# Words that a task remembers in either of two generations, none longer than CACHED_CHARS: some 40 MB.
CACHED_WORDS, CACHED_CHARS = 100_000, 64
LOWEST = float("-inf")
# No piece starts like this; an empty tuple, so that it counts as false.
END = ()


def model_bytes(path: str = MODEL_PATH) -> bytes:
    """A model file, at most MAX_BROADCAST_BYTES, as it is sent to tasks."""
    with open(path, "rb") as file:
        data = file.read(MAX_BROADCAST_BYTES + 1)
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{path} has more than {MAX_BROADCAST_BYTES} bytes")
    return data


class Words(dict):
    """Packed ids by word, made when first asked for; ``front`` stands before the word."""

    def __init__(self, pieces: Pieces, front: str):
        super().__init__()
        self.pieces, self.front = pieces, front
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        """Start a generation: words that are asked for again are taken over, others are dropped with the next."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is not None:
            self[word] = found
            return found
        found = array("i", self.pieces.path(self.front + word)[1]).tobytes()
        if len(word) <= CACHED_CHARS:
            self[word] = found
        return found


def pieces_of(model: bytes) -> tuple[dict, list, list]:
    """Score and id by piece, the ids of bytes, and what every id stands for."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = read.get_piece_size()
    byte_ids, surface, pieces = [0] * 256, [b""] * n, {}
    for i in range(n):
        piece = read.id_to_piece(i)
        if read.is_byte(i):
            value = int(piece[3:-1], 16)
            byte_ids[value], surface[i] = i, bytes([value])
        elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
            pieces[piece] = (read.get_score(i), i)
            surface[i] = piece.replace(SPACE, " ").encode()
    return pieces, byte_ids, surface


def vocabulary(model: bytes) -> tuple:
    """What ``Pieces`` needs of a model, as plain values: made once, sent to every task.

    Pieces that score less than their own parts are in no best segmentation and left out.
    """
    pieces, byte_ids, surface = pieces_of(model)
    unknown = min((s for s, _ in pieces.values()), default=0.0) - UNKNOWN_PENALTY
    whole = Pieces((pieces, byte_ids, surface, unknown, ""))
    useful = {}
    for piece, found in pieces.items():
        # A single sign has no parts.
        whole.table[piece] = None
        if len(piece) == 1 or whole.path(piece)[0] <= found[0]:
            useful[piece] = whole.table[piece] = found
    for piece in useful:
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} crosses the front of a space and beats its parts")
    return useful, byte_ids, surface, unknown, "" if any("\n" in p for p in useful) else "\n"


class Pieces:
    """A vocabulary as a lattice of scored pieces, with a cache of encoded words.

    Nothing useful crosses the front of a run of spaces, nor a line break where no piece
    has one: texts are cut there.
    """

    def __init__(self, known: tuple):
        self.pieces, self.byte_ids, self.surface, self.unknown, self.cuts = known
        self.longest = max(map(len, self.pieces), default=1)
        # Looked up per start with growing ends: (score, id), or None for the mere start of a piece.
        self.table: dict[str, tuple[float, int] | None] = {}
        for piece, found in self.pieces.items():
            for end in range(1, len(piece)):
                self.table.setdefault(piece[:end], None)
            self.table[piece] = found
        self.words = re.compile(f" *[^ {self.cuts}]+| +" + (f"|[{self.cuts}]" if self.cuts else ""))
        self.inner, self.spaced = Words(self, ""), Words(self, SPACE)

    def path(self, text: str, begin: int = 0, own: int | None = None, leave: int = 0) -> tuple[float, list[int]]:
        """Best score and ids of the way from ``begin`` to ``own + leave``.

        ``text`` has spaces as in the vocabulary. Only the last piece may reach beyond
        ``own``. Of equal ways the one whose last piece starts first wins, at every place.
        """
        own = len(text) if own is None else own
        best = [LOWEST] * (own + 1)
        back: list = [None] * (own + 1)
        best[begin] = 0.0
        final, last = LOWEST, None
        get, size, unknown = self.table.get, len(text), self.unknown
        for p in range(begin, own):
            here = best[p]
            if here == LOWEST:
                continue
            end = p + 1
            found = get(text[p], END)
            if not found and here + unknown > best[end]:
                best[end], back[end] = here + unknown, (p, None)
            while found is not END:
                if found:
                    score = here + found[0]
                    if end <= own:
                        if score > best[end]:
                            best[end], back[end] = score, (p, found[1])
                    elif end == own + leave and score > final:
                        final, last = score, (p, found[1])
                if end == size:
                    break
                end += 1
                found = get(text[p:end], END)
        ids: list[int] = []
        at = own
        if leave:
            if last is None:
                return LOWEST, []
            at, i = last
            ids.append(i)
        else:
            final = best[own]
            if final == LOWEST:
                return LOWEST, []
        while at > begin:
            p, i = back[at]
            if i is None:
                ids += [self.byte_ids[b] for b in reversed(text[p:at].encode())]
            else:
                ids.append(i)
            at = p
        return final, ids[::-1]

    def flush_score(self, text: str) -> float:
        """Best score of a text that starts and ends at cuts."""
        return sum(self.path(w.replace(" ", SPACE))[0] * n for w, n in Counter(self.words.findall(text)).items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of texts whose spaces are still spaces and that start at a cut."""
        out = []
        for text in texts:
            if len(self.inner) + len(self.spaced) > CACHED_WORDS:
                self.inner.age()
                self.spaced.age()
            if SPACE in text:
                text = text.replace(SPACE, " ")
            if "  " in text or not self.cuts:
                words = self.words.findall(text)
                out.append(b"".join([self.inner[w.replace(" ", SPACE)] for w in words]))
                continue
            ids = []
            for line in text.split(self.cuts):
                first, *others = line.split(" ")
                ids.append(self.inner[first] + b"".join(map(self.spaced.__getitem__, others)))
            out.append(self.inner[self.cuts].join(ids))
        return out

    def transfer(self, text: str, own: int) -> np.ndarray:
        """Best scores from a piece that reaches i characters in to one that reaches j out."""
        m = self.longest
        best = np.full((own + m + 1, m), LOWEST)
        for i in range(min(m, own + 1)):
            best[i, i] = 0.0
        text = text.replace(" ", SPACE)
        for p in range(own):
            here = best[p]
            if text[p] not in self.pieces:
                np.maximum(best[p + 1], here + self.unknown, out=best[p + 1])
            for end in range(p + 1, len(text) + 1):
                if text[p:end] not in self.table:
                    break
                found = self.table[text[p:end]]
                if found is not None:
                    np.maximum(best[end], here + found[0], out=best[end])
        return best[own:own + m].T.copy()


def chunks(text: str, longest: int) -> list[tuple[str, int, bool, bool]]:
    """A giant text's chunks: (text with what a piece may reach beyond, own length, whether a
    piece may reach in, whether one may reach out).

    A chunk ends in front of a space or at a line break if one is near, so none reaches out.
    """
    out, at, reached = [], 0, False
    while at < len(text):
        end, reaches = len(text), False
        if len(text) - at >= 2 * CHUNK_CHARS:
            end = at + CHUNK_CHARS
            near = max(text.rfind(" ", end - CUT_SEARCH, end), text.rfind("\n", end - CUT_SEARCH, end))
            while near > at and text[near] == " " == text[near - 1]:
                near -= 1
            reaches = near <= at
            end = end if reaches else near
        out.append((text[at:end + longest - 1] if reaches else text[at:end], end - at, reached, reaches))
        at, reached = end, reaches
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return np.max(a[..., :, :, None] + b[..., None, :, :], axis=-2)


def prefix_products(matrices: np.ndarray, block: int = 512) -> np.ndarray:
    """The products of the first 1, 2, … matrices: by doubling within blocks, then block by block."""
    done: list[np.ndarray] = []
    for at in range(0, len(matrices), block):
        part, step = matrices[at:at + block], 1
        while step < len(part):
            part = np.concatenate([part[:step], product(part[:-step], part[step:])])
            step *= 2
        done.append(product(done[-1][-1:], part) if done else part)
    return np.concatenate(done)


def boundary_states(matrices: np.ndarray) -> list[tuple[int, int]]:
    """Per chunk how far pieces reach in and out on a best way that starts and ends flush."""
    before = prefix_products(matrices)[:, 0, :]
    states = [0] * (len(matrices) + 1)
    for k in range(len(matrices) - 1, 0, -1):
        states[k] = int(np.argmax(before[k - 1] + matrices[k][:, states[k + 1]]))
    return list(zip(states, states[1:]))


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def _giant_ids(giants: DataFrame, model) -> DataFrame:
    """(doc, text, ids) of giant documents, through chunks."""
    # Stored, since the numbers of rows have to stay the same.
    rows = materialise(giants.withColumn("row", F.monotonically_increasing_id()), "giants")

    def start_split():
        longest = Pieces(model.value).longest

        def step(batch):
            cut = [
                (row, no, *chunk)
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())
                for no, chunk in enumerate(chunks(" " + text.replace(SPACE, " "), longest))
            ]
            return list(zip(*cut))

        return step

    parts = materialise(emit(
        rows.select("row", "text"), start_split,
        "row bigint, no int, part string, own int, reached boolean, reaches boolean",
    ), "chunks")

    def start_transfer():
        pieces = Pieces(model.value)

        def matrix(part, own, reached, reaches):
            if reached or reaches:
                found = pieces.transfer(part, own)
            else:
                found = np.full((pieces.longest, pieces.longest), LOWEST)
                found[0, 0] = pieces.flush_score(part)
            return found.astype("<f8").tobytes()

        return lambda batch: [[
            matrix(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("part", "own", "reached", "reaches")])
        ]]

    def states(key, frame):
        import pandas as pd

        frame = frame.sort_values("no")
        stack = np.stack([np.frombuffer(x, dtype="<f8") for x in frame["matrix"]])
        side = round(stack.shape[1] ** 0.5)
        found = boundary_states(stack.reshape(len(stack), side, side))
        return pd.DataFrame({
            "row": frame["row"].to_numpy(), "no": frame["no"].to_numpy(),
            "enter": [a for a, _ in found], "leave": [b for _, b in found],
        })

    # A group is the matrices of one text: 2 KB a chunk, 128 MB for the longest a cell can hold.
    moved = append(parts, start_transfer, "matrix binary").select("row", "no", "matrix")
    placed = moved.groupBy("row").applyInPandas(states, "row bigint, no int, enter int, leave int")

    def start_trace():
        pieces = Pieces(model.value)

        def ids(part, own, reached, reaches, enter, leave):
            if reached or reaches:
                found = pieces.path(part.replace(" ", SPACE), enter, own, leave)[1]
                return np.array(found, dtype="<i4").tobytes()
            return pieces.encode([part])[0]

        names = ("part", "own", "reached", "reaches", "enter", "leave")
        return lambda batch: [[ids(*row) for row in zip(*[batch.column(c).to_pylist() for c in names])]]

    def joined(key, frame):
        import pandas as pd

        return pd.DataFrame({"row": [key[0]], "packed": [b"".join(frame.sort_values("no")["packed"])]})

    traced = append(parts.join(placed, ["row", "no"]), start_trace, "packed binary").select("row", "no", "packed")
    whole = traced.groupBy("row").applyInPandas(joined, "row bigint, packed binary")
    ids = append(whole, lambda: lambda batch: [id_lists(batch.column("packed").to_pylist())], "ids array<int>")
    return rows.join(ids.select("row", "ids"), "row").select("doc", "text", "ids")


def encode(docs: DataFrame, carry=None, model_path: str = MODEL_PATH, giant_chars: int = GIANT_CHARS) -> DataFrame:
    """``doc`` and ``text`` of every document with ``ids`` and ``n_pieces``: the best-scoring pieces.

    As in SentencePiece a space is put in front of a text that is not empty; a character
    without a piece becomes its bytes. Missing and empty texts have no pieces. Rows are
    encoded one by one, so repeated rows and empty tables need no rule. Where ways of
    equal score differ across a chunk's hard end, a giant text may take another of them.
    """
    model = docs.sparkSession.sparkContext.broadcast(vocabulary(model_bytes(model_path)))
    packed = pack(docs, carry)

    def start():
        pieces = Pieces(model.value)
        return lambda batch: [id_lists(pieces.encode([
            " " + t if t else "" for t in batch.column("text").to_pylist()
        ]))]

    giant = F.coalesce(F.length("text"), F.lit(0)) > giant_chars
    ordinary = append(packed.where(~giant), start, "ids array<int>")
    found = ordinary.unionByName(_giant_ids(packed.where(giant), model))
    return found.withColumn("n_pieces", F.size("ids").cast("bigint"))


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Add ``decoded``, the text of ``ids``: a missing list gives an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_bytes(model_path)))

    def start():
        surface = pa.array(model.value[2], pa.binary())

        def step(batch):
            lists = batch.column("ids")
            found = surface.take(lists.flatten())
            ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            if not len(found):
                return [[""] * len(lists)]
            _, offsets, data = found.buffers()
            places = np.frombuffer(offsets, "<i4", len(found) + 1, 4 * found.offset)[ends].tolist()
            data = data.to_pybytes() if data else b""
            return [[data[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(places, places[1:])]]

        return step

    return append(encoded, start, "decoded string")


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids with their pieces; the last stage, so it returns no texts."""
    from clinigrid.llm.lattice import encode_lattice

    found = encode_lattice(docs)
    return found.select("doc.doc_id", "n_pieces", "ids")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from clinigrid.llm.lattice import encode_lattice

    encoded = encode_lattice(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])
    found = decode(encoded)
    return found.select(
        "doc.doc_id", "n_pieces", F.xxhash64("ids").alias("ids_xxhash64"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


ship(__name__)
