"""Blocks of edge ends for label propagation: what one task counts for all trials at once.

A block is a bounded run of ends (v, u, w) in the order of v, so a vertex with very many
ends lies in several blocks. Vertices are numbers in the order of their ids; inside a block
they are positions in its sorted list ``ids``. A block also knows the labels of all
vertices it meets, in every trial; ``graph.settled_labels`` moves news between blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FRAME = "block long, ids binary, v binary, u binary, w array<{kind}>, split binary, home binary"
VOTES = "trial int, id long, label long, w {kind}, own int"
NEWS = "block long, trial int, id long, label long, restless boolean, again boolean, number int"
VERDICTS = "trial int, id long, label long, beaten boolean, told boolean"
LABELS = "trial int, id long, label long"
# Whole-number weights wider than this Arrow type are added as Python numbers.
PLAIN = pa.int64()
# So many different draws.
DRAWS = 1 << 20


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[i], …, first[i] + n[i] - 1 of every i, and the i of each."""
    owner = np.repeat(np.arange(len(n)), n)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def frame_of(ends: pa.Table) -> dict:
    """The columns of a block that stay: ends (v, u, w, home, last), the first and last block of v."""
    v, u = column(ends, "v"), column(ends, "u")
    order = np.argsort(v, kind="stable")
    ids = np.unique(np.concatenate([v, u]))
    block = ends["block"][0].as_py()
    at = np.searchsorted(ids, v[order])
    split, home = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    split[at] = (column(ends, "home") != column(ends, "last"))[order]
    home[at] = (column(ends, "home") == block)[order]
    return {
        "block": block, "ids": ids.tobytes(), "v": at.astype("i4").tobytes(),
        "u": np.searchsorted(ids, u[order]).astype("i4").tobytes(), "w": ends["w"].take(pa.array(order)).combine_chunks(),
        "split": split.tobytes(), "home": home.tobytes(),
    }


class Block:
    """One block, read off its row."""

    def __init__(self, row: pa.Table, trials: int):
        held = {c: row[c][0].as_buffer() for c in ("ids", "v", "u", "split", "home")}
        self.ids = np.frombuffer(held["ids"], "i8")
        self.v, self.u = np.frombuffer(held["v"], "i4"), np.frombuffer(held["u"], "i4")
        self.split, self.home = np.frombuffer(held["split"], bool), np.frombuffer(held["home"], bool)
        self.degree = np.bincount(self.v, minlength=len(self.ids))
        self.first = np.cumsum(self.degree) - self.degree
        self.trials, self.row = trials, row

    def weights(self) -> np.ndarray:
        w = self.row["w"][0].values
        return w.to_numpy() if w.type == PLAIN else np.array([int(x) for x in w.to_pylist()], dtype=object)

    def places(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Trial and position of rows (trial, id)."""
        return column(rows, "trial"), np.searchsorted(self.ids, column(rows, "id"))

    def labels(self, news: pa.Table) -> np.ndarray:
        """Labels by trial and position, with the news of the rounds since they were stored."""
        found = np.frombuffer(self.row["labels"][0].as_buffer(), "i8").reshape(self.trials, -1).copy()
        moved = news.filter(pc.is_valid(news["label"])).sort_by("number")
        t, at = self.places(moved)
        found[t, at] = column(moved, "label")
        return found

    def near(self, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trial, v) of all ends whose u is one of the given places, loops left out."""
        by_u = np.argsort(self.u, kind="stable")
        n = np.bincount(self.u, minlength=len(self.ids))
        end, owner = runs((np.cumsum(n) - n)[at], n[at])
        v = self.v[by_u[end]]
        other = v != at[owner]
        return t[owner][other], v[other]

    def active(self, news: pa.Table, number: int) -> np.ndarray:
        """Which votes of a round are to be counted anew; in the first round all."""
        here = np.broadcast_to(self.degree > 0, (self.trials, len(self.ids)))
        if number == 0:
            return here
        found = np.zeros(here.shape, bool)
        latest = news.filter(pc.equal(news["number"], number - 1))
        found[self.near(*self.places(latest.filter(latest["restless"])))] = True
        found[self.places(latest.filter(latest["again"]))] = True
        return found & here


def heaviest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trial, id, score, drawn, next): the heaviest of the ends of each v in a batch, by trial.

    Ends (v, u, w, drawn), sorted by v and u, with one hash a trial. In trial 0 edges weigh
    w, in others between half and one and a half of it. Of equal scores the larger draw goes
    first, then the larger u.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        v, u = batch["v"], batch["u"]
        draws = batch["drawn"].flatten().to_numpy().reshape(batch.num_rows, -1) & (DRAWS - 1)
        draws = draws / float(DRAWS)
        factor = draws + 0.5
        factor[:, 0] = 1.0
        score = batch["w"].to_numpy()[:, None] * factor
        new = np.append(True, pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)).astype(bool)
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        best = np.maximum.reduceat(score, start)
        drawn = np.where(score == best[group], draws, -1.0)
        top = np.maximum.reduceat(drawn, start)
        row = np.maximum.reduceat(np.where(drawn == top[group], np.arange(len(v))[:, None], -1), start)
        trials = score.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.tile(np.arange(trials), len(start)), pa.int32()), v.take(pa.array(np.repeat(start, trials))),
            pa.array(best.ravel()), pa.array(top.ravel()), u.take(pa.array(row.ravel())),
        ], ["trial", "id", "score", "drawn", "next"])


def wide(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind) if kind == PLAIN else pa.array([Decimal(int(x)) for x in values], kind)


def votes(row: pa.Table, news: pa.Table, trials: int, number: int) -> pa.Table:
    """Votes that can change a label.

    Of a vertex that lies in this block alone these are the label that wins and its own, and
    only if it wants another; of a split one the sums of all labels in this block, and its own.
    """
    block = Block(row, trials)
    labels = block.labels(news)
    t, v = np.nonzero(block.active(news, number))
    end, pair = runs(block.first[v], block.degree[v])
    label = labels[t[pair], block.u[end]]
    order = np.argsort(pair * (labels.max() + 1) + label)
    pair, label = pair[order], label[order]
    start = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (label[1:] != label[:-1]))[: len(pair)])
    kind = row.schema.field("w").type.value_type
    weights = block.weights()[end[order]]
    if not len(start):
        score = best = weights
    else:
        score = np.add.reduceat(weights, start)
        pair, label = pair[start], label[start]
        best = np.maximum.reduceat(score, np.flatnonzero(np.append(True, pair[1:] != pair[:-1])))
    top = np.flatnonzero((score == best[pair]).astype(bool))
    now = labels[t, v]
    kept = np.zeros(len(t), bool)
    kept[pair[top][label[top] == now[pair[top]]]] = True
    # Written from the largest label down, so the smallest of the best stays.
    winner = np.zeros(len(t), np.int64)
    winner[pair[top][::-1]] = top[::-1]
    split = block.split[v]
    told = np.flatnonzero(split | ~kept)
    shown = np.concatenate([winner[~split & ~kept], np.flatnonzero(split[pair])])
    who = np.concatenate([pair[shown], told])
    return pa.table({
        "trial": pa.array(t[who], pa.int32()), "id": pa.array(block.ids[v[who]], pa.int64()),
        "label": pa.array(np.concatenate([label[shown], now[told]]), pa.int64()),
        "w": wide(np.concatenate([score[shown], np.zeros(len(told), score.dtype)]), kind),
        "own": pa.array(np.repeat([0, 1], [len(shown), len(told)]), pa.int32()),
    })


def verdicts(row: pa.Table, asking: pa.Table, trials: int) -> pa.Table:
    """Of restless vertices (trial, id, wanted, turn): does a restless neighbour here come first?

    Split vertices that have a restless neighbour here are told, as other blocks cannot see it.
    """
    block = Block(row, trials)
    t, at = block.places(asking)
    turn = column(asking, "turn")
    restless = np.zeros((trials, len(block.ids)), bool)
    restless[t, at] = True
    turns = np.zeros(restless.shape, np.int64)
    turns[t, at] = turn
    mine = np.flatnonzero(block.degree[at] > 0)
    end, owner = runs(block.first[at[mine]], block.degree[at[mine]])
    other, me, trial = block.u[end], at[mine][owner], t[mine][owner]
    theirs, own = turns[trial, other], turn[mine][owner]
    before = restless[trial, other] & ((theirs < own) | ((theirs == own) & (other < me)))
    beaten = np.bincount(owner[before], minlength=len(mine)) > 0
    near_t, near_v = block.near(t, at)
    far = block.split[near_v]
    told = np.unique(np.stack([near_t[far].astype(np.int64), near_v[far].astype(np.int64)], 1), axis=0)
    none = [None] * len(told)
    return pa.table({
        "trial": pa.array(np.concatenate([t[mine], told[:, 0]]), pa.int32()),
        "id": pa.array(block.ids[np.concatenate([at[mine], told[:, 1]])], pa.int64()),
        "label": pa.concat_arrays([pa.array(column(asking, "wanted")[mine], pa.int64()), pa.array(none, pa.int64())]),
        "beaten": pa.concat_arrays([pa.array(beaten, pa.bool_()), pa.array(none, pa.bool_())]),
        "told": pa.array(np.repeat([False, True], [len(mine), len(told)]), pa.bool_()),
    })


def opened(ends: pa.Table, start: pa.Table, trials: int) -> pa.Table:
    """The row of a block from its ends and the first labels of all vertices it meets."""
    frame = frame_of(ends)
    ids = np.frombuffer(frame["ids"], "i8")
    labels = np.zeros((trials, len(ids)), np.int64)
    labels[column(start, "trial"), np.searchsorted(ids, column(start, "id"))] = column(start, "label")
    w = frame.pop("w")
    table = pa.table({c: pa.array([x], pa.int64() if c == "block" else pa.binary()) for c, x in frame.items()})
    return table.add_column(4, "w", pa.ListArray.from_arrays([0, len(w)], w)).append_column(
        "labels", pa.array([labels.tobytes()], pa.binary())
    )


def renewed(row: pa.Table, news: pa.Table, trials: int) -> pa.Table:
    """The row with its labels as they are now."""
    labels = Block(row, trials).labels(news)
    return row.set_column(row.schema.get_field_index("labels"), "labels", pa.array([labels.tobytes()], pa.binary()))


def listed(row: pa.Table, news: pa.Table, trials: int) -> pa.Table:
    """(trial, id, label) of the vertices whose first block this is."""
    block = Block(row, trials)
    labels, at = block.labels(news), np.flatnonzero(block.home)
    return pa.table({
        "trial": pa.array(np.repeat(np.arange(trials), len(at)), pa.int32()),
        "id": pa.array(np.tile(block.ids[at], trials), pa.int64()),
        "label": pa.array(labels[:, at].ravel(), pa.int64()),
    })
