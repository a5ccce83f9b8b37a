"""SentencePiece encoding by a max-plus parallel scan over a lattice of compatible neighbours.

A row of pieces is what a model of the BPE type makes of a text exactly when every two
neighbours, merged by themselves, stay those two. So a step from one piece to the next scores
0 where they are compatible and minus infinity where they are not, and the best way through
the lattice is the encoding; there is one only.

Ordinary texts are cut where no piece crosses, in front of spaces and between signs that no
piece holds side by side, and the runs in between are remembered.
Giant texts are cut into chunks anywhere. The state at a cut is the piece that lies across it
or ends at it. Every chunk yields the matrix of steps from the states at its start to those at
its end, an associative scan of the matrices gives the state at every cut, and each chunk is
traced back on its own.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.llm.common import append, emit, pack, ship
from clinigrid.llm.merges import APART, Merges, merge_vocabulary
from clinigrid.llm.pieces import (
    CACHED_CHARS, CACHED_WORDS, CHUNK_CHARS, GIANT_CHARS, MODEL_PATH, SPACE, id_lists, model_bytes,
)
from clinigrid.session import materialise

# Pairs of pieces whose compatibility a task remembers: some 15 MB by their texts, some 40 MB by their numbers.
KEPT_PAIRS, KEPT_NUMBERS = 100_000, 400_000
# Matrices whose products are held at once.
BLOCK = 256
# The state in front of a text.
START = (-1, -1)


class Runs(dict):
    """Packed ids by run, made when first asked for; in two generations, as words in ``Words``."""

    def __init__(self, lattice: Lattice, older: dict[str, bytes]):
        super().__init__()
        self.lattice, self.older = lattice, older

    def __missing__(self, run: str) -> bytes:
        found = self.older.get(run)
        if found is None:
            found = array("i", self.lattice.path(run.replace(" ", SPACE))[1]).tobytes()
            if len(run) > CACHED_CHARS:
                return found
        self[run] = found
        return found


class Lattice(Merges):
    """A vocabulary with the compatibility of its pieces; single characters without a piece count as pieces."""

    def __init__(self, known: tuple):
        super().__init__(known)
        self.pairs: dict[tuple[str, str], bool] = {}
        # Per piece what holds its last character, and its first, merge by merge.
        self.edges: dict[str, tuple[list, list]] = {}
        # Pieces whose merges do not come in the order of their ranks.
        self.unordered: set[str] = set()
        # Pieces by number: their ids, then numbers for characters that only longer pieces hold.
        self.known_ids = 1 + max((i for _, i in self.pieces.values()), default=-1)
        self.names = [""] * self.known_ids
        for piece, (_, i) in self.pieces.items():
            self.names[i] = piece
        self.names += sorted({c for p in self.pieces for c in p}.difference(self.pieces))
        self.shift = len(self.names).bit_length()
        # Per pair of numbers, left << shift | right, whether they stay.
        self.numbers: dict[int, bool] = {}
        # What may follow a beginning: [number of the piece so far or None, what may follow that] by character.
        self.tree: dict[str, list] = {}
        for number, piece in enumerate(self.names):
            after, node = self.tree, None
            for c in piece:
                node = after.setdefault(c, [None, {}])
                after = node[1]
            if node:
                node[0] = number
        self.runs_of = re.compile(self.run_pattern()).findall
        self.runs = Runs(self, {})

    def run_pattern(self) -> str:
        """Runs of characters that pieces hold side by side, by one step or several, with the spaces in front.

        No piece crosses from one run to the next.
        """
        lead: dict[str, str] = {}

        def first(c):
            while lead.setdefault(c, c) != c:
                lead[c] = lead[lead[c]]
                c = lead[c]
            return c

        for a, b in self.inside:
            if a != SPACE:
                lead[first(a)] = first(b)
        groups: dict[str, list[str]] = {}
        for c in sorted(lead):
            groups.setdefault(first(c), []).append(re.escape(c))
        signs = sorted(map("".join, groups.values()), key=len, reverse=True)
        return "|".join([*(f" *[{s}]+" for s in signs), f" *[^ {''.join(signs)}]+", " +"])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of texts whose spaces are still spaces and that start at a cut."""
        out = []
        for text in texts:
            if len(self.runs) > CACHED_WORDS:
                self.runs = Runs(self, dict(self.runs))
            if SPACE in text:
                text = text.replace(SPACE, " ")
            out.append(b"".join(map(self.runs.__getitem__, self.runs_of(text))))
        return out

    def edge(self, piece: str) -> tuple[list, list]:
        """What lies at a piece's right and left end while it is merged: (text, rank of the merge that ends it)."""
        found = self.edges.get(piece)
        if found is None:
            parts, rank, latest = list(piece), self.rank.get, -1
            sides = ([], [])
            while len(parts) > 1:
                pairs = [rank(a + b, APART) for a, b in zip(parts, parts[1:])]
                best = min(pairs)
                if best < latest:
                    self.unordered.add(piece)
                latest = best
                i = pairs.index(best)
                if i == len(pairs) - 1:
                    sides[0].append((parts[-1], best))
                if i == 0:
                    sides[1].append((parts[0], best))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            for side in sides:
                side.append((piece, APART))
            found = self.edges[piece] = sides
        return found

    def stay(self, left: str, right: str) -> bool:
        """Follow both pieces' merges at the place where they meet; a merge across it would have to come first.

        Parts of a piece are learned before it, so merges of one piece come in the order of their ranks; the
        few pairs with another piece are merged whole. Of equal ranks the one further left comes first.
        """
        a, b, i, j, rank = self.edge(left)[0], self.edge(right)[1], 0, 0, self.rank.get
        if left in self.unordered or right in self.unordered:
            return self.merged(left + right) == [left, right]
        while True:
            (mine, until), (theirs, then) = a[i], b[j]
            across = rank(mine + theirs, APART)
            if across < until and across <= then and across != APART:
                return False
            if until == then == APART:
                return True
            if until <= then:
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        """Whether two neighbours stay as they are when they are merged by themselves."""
        if left[-1] + right[0] not in self.inside:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.stay(left, right)
        return found

    def id_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        return [found[1]] if found else [self.byte_ids[b] for b in piece.encode()]

    def stays(self, pair: int) -> bool:
        """``compatible`` by the pair's numbers."""
        if len(self.numbers) >= KEPT_NUMBERS:
            self.numbers.clear()
        left, right = self.names[pair >> self.shift], self.names[pair & (1 << self.shift) - 1]
        found = self.numbers[pair] = left[-1] + right[0] not in self.inside or self.stay(left, right)
        return found

    def path(self, text: str) -> tuple[None, list[int]]:
        """The ids of a text that has spaces as in the vocabulary and starts at a cut.

        Longest pieces are tried first. The beginning of a text up to any place has one
        way, so a place from which no piece goes on is never tried again.
        """
        size, tree, longest, shift, known = len(text), self.tree, self.longest, self.shift, self.numbers.get
        dead = bytearray(size + 1)
        # Per piece set: where it starts, its number, and the shorter ones that start there, by end and number.
        way: list[tuple[int, int, list[tuple[int, int]]]] = []
        # A character that no piece holds has a number below 0; no merge crosses its edges.
        at, before, ends = 0, -1, None
        while at < size:
            if ends is None:
                ends, end, after = [], at, tree
                for c in text[at:at + longest]:
                    node = after.get(c)
                    if node is None:
                        break
                    end += 1
                    number, after = node
                    if number is not None:
                        ends.append((end, number))
                if not ends:
                    ends.append((at + 1, -1 - ord(text[at])))
            while ends:
                end, number = ends.pop()
                if dead[end]:
                    continue
                if before >= 0 and number >= 0:
                    pair = before << shift | number
                    stays = known(pair)
                    if not (self.stays(pair) if stays is None else stays):
                        continue
                way.append((at, number, ends))
                at, before, ends = end, number, None
                break
            else:
                dead[at] = 1
                at, _, ends = way.pop()
                before = way[-1][1] if way else -1
        ids, known_ids = [], self.known_ids
        for _, number, _ in way:
            if 0 <= number < known_ids:
                ids.append(number)
            else:
                ids += self.id_of(chr(-1 - number) if number < 0 else self.names[number])
        return None, ids

    def across(self, part: str, cut: int) -> list[tuple[int, int]]:
        """The states at a cut: (start, end) of what may lie across it or end at it, in order."""
        found = []
        for start in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(part), start + self.longest) + 1):
                if end - start == 1 or part[start:end] in self.pieces:
                    found.append((start, end))
        return found

    def ways(self, part: str, begin: int, stop: int, entries: list[tuple[int, int]]):
        """Per place and start of the piece that ends there: which entries come so far, and the start of the piece before.

        Pieces that start in [begin, stop) are set behind the entries. Entries are bits.
        """
        at: dict[int, dict[int, list]] = {}
        for i, (start, end) in enumerate(entries):
            place = begin if (start, end) == START else end
            at.setdefault(place, {}).setdefault(start, [0, None])[0] |= 1 << i
        table, size = self.table, len(part)
        for p in range(begin, stop):
            here = at.get(p)
            if not here:
                continue
            end = p + 1
            while True:
                piece = part[p:end]
                if end == p + 1 or table.get(piece):
                    for start, (bits, _) in here.items():
                        if start == START[0] or self.compatible(part[start:p], piece):
                            held = at.setdefault(end, {}).setdefault(p, [0, start])
                            held[0] |= bits
                if end == size or piece not in table:
                    break
                end += 1
        return at

    def exits(self, part: str, stop: int) -> list[tuple[int, int]] | None:
        """States at a chunk's end; None at the text's end, where any last piece will do."""
        return None if stop == len(part) else self.across(part, stop)

    def flush(self, part: str, begin: int, stop: int) -> tuple[int, int] | None:
        """The first and the last place of a chunk that no piece crosses, or None without any.

        The last lies before the chunk's end, so that the piece that ends there is told, or is the text's end.
        """
        def crossed(at):
            return 0 < at < len(part) and part[at - 1:at + 1] in self.inside

        high = stop if stop == len(part) else stop - 1
        first = next((at for at in range(begin, high + 1) if not crossed(at)), None)
        if first is None:
            return None
        return first, next(at for at in range(high, first - 1, -1) if not crossed(at))

    def steps(self, part: str, begin: int, own: int) -> np.ndarray:
        """The matrix of a chunk, its 0 as True and its minus infinity as False.

        All ways meet at places that no piece crosses, so only what stands before the first
        and after the last of them is looked at.
        """
        entries = self.across(part, begin) if begin else [START]
        stop = begin + own
        ends, flush = self.exits(part, stop), self.flush(part, begin, stop)
        if flush is None:
            columns = self.columns(self.ways(part, begin, stop, entries), ends, stop)
        else:
            first, last = flush
            reached = self.columns(self.ways(part, begin, first, entries), None, first)[0]
            columns = [reached if bits else 0 for bits in self.columns(self.ways(part, last, stop, [START]), ends, stop)]
        return np.array([[bits >> i & 1 for bits in columns] for i in range(len(entries))], dtype=bool)

    @staticmethod
    def columns(at: dict, ends: list[tuple[int, int]] | None, stop: int) -> list[int]:
        """Per state at the end the entries from which there is a way to it; one column where any last piece will do."""
        if ends is not None:
            return [at.get(end, {}).get(start, (0,))[0] for start, end in ends]
        every = 0
        for bits, _ in at.get(stop, {}).values():
            every |= bits
        return [every]

    def trace(self, part: str, begin: int, own: int, enter: int, leave: int) -> list[int]:
        """The ids of the pieces behind the state at a chunk's start, up to the state at its end."""
        entry = self.across(part, begin)[enter] if begin else START
        stop = begin + own
        ends, flush = self.exits(part, stop), self.flush(part, begin, stop)
        goal = None if ends is None else ends[leave]
        if flush is None:
            return self.back(part, begin, stop, entry, goal)
        first, last = flush
        middle = self.encode([part[first:last].replace(SPACE, " ")])[0]
        head = self.back(part, begin, first, entry, None)
        return head + np.frombuffer(middle, dtype="<i4").tolist() + self.back(part, last, stop, START, goal)

    def back(self, part: str, begin: int, stop: int, entry: tuple[int, int], goal: tuple[int, int] | None) -> list[int]:
        """The ids of the one way from an entry to a state, or to any last piece."""
        if goal is None and stop == (begin if entry == START else entry[1]):
            return []
        at = self.ways(part, begin, stop, [entry])
        start, end = (next(iter(at[stop])), stop) if goal is None else goal
        out = []
        while (start, end) != entry and start >= 0:
            out.append(part[start:end])
            start, end = at[end][start][1], start
        return [i for piece in reversed(out) for i in self.id_of(piece)]


def chunks(text: str, longest: int, chars: int) -> list[tuple[str, int, int]]:
    """(text with what pieces may reach on either side, where the chunk begins in it, its length)."""
    out, at = [], 0
    while at < len(text):
        own = chars if len(text) - at >= 2 * chars else len(text) - at
        low, end = max(0, at - longest), at + own
        high = len(text) if end == len(text) else end + longest - 1
        out.append((text[low:high], at - low, own))
        at = end
    return out


def packed(steps: np.ndarray) -> bytes:
    return np.array(steps.shape, dtype="<i4").tobytes() + np.packbits(steps).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    rows, columns = np.frombuffer(data[:8], dtype="<i4").tolist()
    return np.unpackbits(np.frombuffer(data[8:], dtype=np.uint8), count=rows * columns).reshape(rows, columns).astype(bool)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices of 0 (True) and minus infinity (False)."""
    return np.matmul(a.astype(np.float32), b.astype(np.float32)) > 0


def prefix_products(stack: np.ndarray) -> np.ndarray:
    """The products of the first 1, 2, … matrices of a stack, by doubling."""
    step = 1
    while step < len(stack):
        stack = np.concatenate([stack[:step], product(stack[:-step], stack[step:])])
        step *= 2
    return stack


def boundary_states(matrices: list[np.ndarray], block: int = BLOCK) -> list[tuple[int, int]]:
    """Per chunk the numbers of the states at its start and at its end on the way from 0 to 0."""
    side = max(max(m.shape) for m in matrices)
    before, reached = [], np.zeros((1, side), dtype=bool)
    reached[0, 0] = True
    for at in range(0, len(matrices), block):
        stack = np.zeros((len(matrices[at:at + block]), side, side), dtype=bool)
        for k, m in enumerate(matrices[at:at + block]):
            stack[k, :m.shape[0], :m.shape[1]] = m
        rows = product(reached, prefix_products(stack))[:, 0, :]
        before.extend(rows)
        reached = rows[-1:]
    states = [0] * (len(matrices) + 1)
    for k in range(len(matrices) - 1, 0, -1):
        m = matrices[k]
        states[k] = int(np.argmax(before[k - 1][:m.shape[0]] & m[:, states[k + 1]]))
    return list(zip(states, states[1:]))


def _giant_ids(giants: DataFrame, model, chunk_chars: int) -> DataFrame:
    """(doc, text, ids) of giant documents, through chunks."""
    # Stored, since the numbers of rows have to stay the same.
    rows = materialise(giants.withColumn("row", F.monotonically_increasing_id()), "giants")

    def start_split():
        longest = Lattice(model.value).longest

        def step(batch):
            cut = [
                (row, no, *chunk)
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())
                for no, chunk in enumerate(chunks(SPACE + text.replace(" ", SPACE), longest, chunk_chars))
            ]
            return list(zip(*cut))

        return step

    parts = materialise(emit(
        rows.select("row", "text"), start_split, "row bigint, no int, part string, begin int, own int"
    ), "chunks")
    columns = ("part", "begin", "own")

    def start_steps():
        lattice = Lattice(model.value)
        return lambda batch: [[
            packed(lattice.steps(*row)) for row in zip(*[batch.column(c).to_pylist() for c in columns])
        ]]

    def states(key, frame):
        import pandas as pd

        frame = frame.sort_values("no")
        found = boundary_states([unpacked(m) for m in frame["steps"]])
        return pd.DataFrame({
            "row": frame["row"].to_numpy(), "no": frame["no"].to_numpy(),
            "enter": [a for a, _ in found], "leave": [b for _, b in found],
        })

    # A group is the matrices of one text, a few hundred bytes a chunk.
    moved = append(parts, start_steps, "steps binary").select("row", "no", "steps")
    placed = moved.groupBy("row").applyInPandas(states, "row bigint, no int, enter int, leave int")

    def start_trace():
        lattice = Lattice(model.value)
        return lambda batch: [[
            np.array(lattice.trace(*row), dtype="<i4").tobytes()
            for row in zip(*[batch.column(c).to_pylist() for c in (*columns, "enter", "leave")])
        ]]

    def joined(key, frame):
        import pandas as pd

        return pd.DataFrame({"row": [key[0]], "packed": [b"".join(frame.sort_values("no")["packed"])]})

    traced = append(parts.join(placed, ["row", "no"]), start_trace, "packed binary").select("row", "no", "packed")
    whole = traced.groupBy("row").applyInPandas(joined, "row bigint, packed binary")
    ids = append(whole, lambda: lambda batch: [id_lists(batch.column("packed").to_pylist())], "ids array<int>")
    return rows.join(ids.select("row", "ids"), "row").select("doc", "text", "ids")


def encode_lattice(
    docs: DataFrame, carry=None, model_path: str = MODEL_PATH, giant_chars: int = GIANT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``doc`` and ``text`` of every document with ``ids`` and ``n_pieces``, as SentencePiece encodes it.

    A space is put in front of a text that is not empty; a character without a piece
    becomes its bytes. Missing and empty texts have no pieces. Rows are encoded one by
    one, so repeated rows and empty tables need no rule. No stretch of a giant text has to
    be encoded by one task. The model has to leave texts as they are before it encodes them.
    """
    model = docs.sparkSession.sparkContext.broadcast(merge_vocabulary(model_bytes(model_path)))
    packed_docs = pack(docs, carry)

    def start():
        lattice = Lattice(model.value)
        return lambda batch: [id_lists(lattice.encode([
            " " + t if t else "" for t in batch.column("text").to_pylist()
        ]))]

    giant = F.coalesce(F.length("text"), F.lit(0)) > giant_chars
    ordinary = append(packed_docs.where(~giant), start, "ids array<int>")
    found = ordinary.unionByName(_giant_ids(packed_docs.where(giant), model, chunk_chars))
    return found.withColumn("n_pieces", F.size("ids").cast("bigint"))


ship(__name__)
