"""First shortest paths for many (start, end) pairs over a graph that was counted to be small.

The graph goes to every task as arrays of neighbours; the pairs are dealt over the tasks. A task searches some thousand pairs at once,
from both ends of each, a level at a time for all of them, the side with fewer edges to follow first. A level is a few sorted arrays, so
no row is made for a node that is met. Where levels would hold too much, the pairs that still wait are searched in two halves.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Edges of a graph that goes to every task: 4 bytes each way.
MOST_EDGES = 4 << 20
# Pairs in hand at a time, rows that several pairs hold at most, pairs of a task, tasks.
PAIRS, HELD, TASK_PAIRS, MOST_TASKS = 4096, 2 << 20, 4096, 4096


def neighbours(near: np.ndarray, far: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges out of each node, ascending: node ``i`` has those from ``first[i]`` up to ``first[i + 1]``."""
    order = np.lexsort((far, near))
    return np.searchsorted(near[order], np.arange(size + 1)), far[order].astype(np.int32)


def _steps(first: np.ndarray, nodes: np.ndarray) -> int:
    return int((first[nodes + 1] - first[nodes]).sum())


def _follow(first: np.ndarray, far: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, neighbour) of every edge, in the order of ``nodes`` and of the neighbours of each."""
    counts = first[nodes + 1] - first[nodes]
    place = np.repeat(np.arange(len(nodes)), counts)
    return place, far[np.arange(len(place)) + (first[nodes] - np.cumsum(counts) + counts)[place]].astype(np.int64)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return near, keys[near] == wanted


class _Seen:
    """Keys met so far, in sorted pieces of falling size, so that many small levels cost no copy of all."""

    def __init__(self, keys: np.ndarray):
        self.pieces, self.size = [np.sort(keys)], len(keys)

    def first_of_new(self, keys: np.ndarray) -> np.ndarray:
        """Places at which keys not met before come first, by key; they count as met."""
        found, at = np.unique(keys, return_index=True)
        for piece in self.pieces:
            fresh = ~_place(piece, found)[1]
            found, at = found[fresh], at[fresh]
        self.size += len(found)
        while self.pieces and len(self.pieces[-1]) <= 2 * len(found):
            found = np.sort(np.concatenate([self.pieces.pop(), found]))
        self.pieces.append(found)
        return at


def search(starts: np.ndarray, ends: np.ndarray, out: tuple, back: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of pairs, their paths as rows): the shortest path from start to end whose other nodes are greater than the start.

    Of equally short paths the first in the order of their nodes: forward levels stand in the order of their paths, so the first way
    to a node is the first path to it; on the way back the first path from a node goes on by its smallest neighbour.
    """
    size = len(out[0]) - 1
    own, of = np.unique(starts, return_inverse=True)
    none = np.zeros(0, np.int64)
    # Levels of (group, node, row of the level before): a start's nodes are shared by its ends, the way back is a pair's own.
    ahead, back_levels = [(np.arange(len(own)), own, none)], [(np.arange(len(ends)), ends, none)]
    seen, known = _Seen(np.arange(len(own)) * size + own), _Seen(np.arange(len(ends)) * size + ends)
    waiting = np.ones(len(starts), bool)
    here, there = np.arange(len(own)), np.arange(len(ends))  # rows of the last levels that still count
    while len(here) and len(there):
        forward, backward = _steps(out[0], ahead[-1][1][here]), _steps(back[0], back_levels[-1][1][there])
        if len(starts) > 1 and min(forward, backward) + seen.size + known.size > HELD + len(own) + len(ends):
            left = np.flatnonzero(waiting)
            for half in np.array_split(left, 2):
                if len(half):
                    for places, paths in search(starts[half], ends[half], out, back):
                        yield half[places], paths
            return
        if forward <= backward:
            group, node, _ = ahead[-1]
            place, t = _follow(*out, node[here])
            kept = t > own[group[here[place]]]
            place, t = here[place[kept]], t[kept]
            at = np.sort(seen.first_of_new(group[place] * size + t))  # the order of paths: the way so far, then the node
            ahead.append((group[place[at]], t[at], place[at]))
            here = np.arange(len(at))
        else:
            pair, node, _ = back_levels[-1]
            place, s = _follow(*back, node[there])
            kept = s >= starts[pair[there[place]]]
            place, s = there[place[kept]], s[kept]
            at = known.first_of_new(pair[place] * size + s)
            back_levels.append((pair[place[at]], s[at], place[at]))
            there = np.arange(len(at))
        group, node, _ = ahead[-1]
        pair, met, _ = back_levels[-1]
        keys = group[here] * size + node[here]
        order = np.argsort(keys)
        near, hit = _place(keys[order], of[pair[there]] * size + met[there])
        over, place = here[order[near[hit]]], there[hit]
        # Of the nodes at which a pair's ends meet, the first in the forward order has the first path.
        ranked = np.lexsort((over, pair[place]))
        done, at = np.unique(pair[place[ranked]], return_index=True)
        if len(done):
            chosen = ranked[at]
            yield done, _paths(ahead, back_levels, over[chosen], place[chosen])
            waiting[done] = False
        # A start and an end go on while they wait for each other and neither side is exhausted.
        reached, left = np.zeros(len(own), bool), np.zeros(len(starts), bool)
        reached[group[here]], left[pair[there]] = True, True
        open_pairs, open_starts = waiting & reached[of] & left, np.zeros(len(own), bool)
        open_starts[of[open_pairs]] = True
        here, there = here[open_starts[group[here]]], there[open_pairs[pair[there]]]


def _paths(ahead: list, back_levels: list, over: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One row per path that meets at row ``over`` of the last forward level and row ``place`` of the last backward level."""
    before, after = [], []
    for _, node, earlier in reversed(ahead):
        before.append(node[over])
        over = earlier[over] if len(earlier) else over
    for (_, _, later), (_, node, _) in zip(reversed(back_levels), list(reversed(back_levels))[1:]):
        place = later[place]
        after.append(node[place])
    return np.stack([*reversed(before), *after], axis=1)


def paths(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """``start, end, members`` of the pairs that have a path, over ``links`` (s, t) of at most ``MOST_EDGES`` rows."""
    spark, table = wanted.sparkSession, links.select(F.col("s").cast("long"), F.col("t").cast("long")).toArrow()
    near, far = table["s"].to_numpy(), table["t"].to_numpy()
    nodes = np.unique(np.concatenate([near, far]))
    s, t = np.searchsorted(nodes, near), np.searchsorted(nodes, far)
    graph = spark.sparkContext.broadcast((nodes, neighbours(s, t, len(nodes)), neighbours(t, s, len(nodes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, out, back = graph.value
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                piece = batch.slice(at, PAIRS)
                (starts, here), (ends, there) = (_place(numbers, piece.column(c).to_numpy()) for c in ("start", "end"))
                starts, ends = starts[here & there], ends[here & there]
                for places, found in search(starts, ends, out, back) if len(starts) else ():
                    members = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(numbers[found.ravel()]))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[starts[places]]), pa.array(numbers[ends[places]]), members], ["start", "end", "members"])

    dealt = wanted.select(F.col("start").cast("long"), F.col("end").cast("long")).repartition(
        min(max(1, -(-wanted.count() // TASK_PAIRS)), MOST_TASKS), "start").sortWithinPartitions("start", "end")
    return dealt.mapInArrow(run, "start long, end long, members array<long>")
