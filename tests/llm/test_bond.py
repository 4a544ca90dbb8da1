import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bond, queries


def brute(rows, is_anchor, relabel=lambda i, label: label):
    points = [(i, relabel(i, label), [math.floor(256 * x) for x in v]) for i, v, label in rows
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in points if i is not None and is_anchor(i)}:
        others = sorted((-score(v, w), math.inf if j is None else j, j, other) for j, other, w in points if j != i)
        for s, _, p, _ in [o for o in others if o[3] == label][:5]:
            inside = [o for o in others if o[3] != label and 30 * -s <= 100 * -o[0] <= 90 * -s][:10]
            out += [(i, p, k + 1, o[2], -s, -o[0]) for k, o in enumerate(inside)]
    return sorted(out, key=repr)


def made(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        v = [x * 0.3 + rng.gauss(0, 0.25) * spread for x in centres[c]]
        rows.append((i, v, c))
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("dims, tile_rows, group_anchors", [(24, 64, 8), (3, 500, 2), (1, 7, 100)])
def test_against_all_pairs(spark, dims, tile_rows, group_anchors):
    rows = made(700, dims, dims)
    got = bond.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 20 == 0, tile_rows=tile_rows, group_anchors=group_anchors)
    want = brute(rows, lambda i: i % 20 == 0)
    assert result(got) == want and len(want) > 100


def test_bounds_shrink_the_bitmap():
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(4000, 64)) * 2 ** np.linspace(7, 0, 64)).astype(int)
    tile = bond.Tile({"ids": range(4000), "labels": [0] * 4000, "width": 8, "dims": 64, "columns": vectors.T.astype("<i8").tobytes()})
    left = []

    def keep(rows, at_least, at_most):
        stay = at_most >= np.partition(at_least, len(rows) - 5)[len(rows) - 5] if len(rows) > 5 else np.ones(len(rows), bool)
        left.append(int(stay.sum()))
        return stay

    rows, scores = bond.scan(tile, vectors[0].astype(np.int64), np.ones(4000, bool), keep)
    whole = vectors @ vectors[0]
    assert set(np.argsort(-whole)[:5]) <= set(rows) and all(whole[r] == s for r, s in zip(rows, scores))
    assert left[3] < 1000 and left[-1] < 20


def test_corner_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 5, 1) + [(100, None, 1), (200, [0.1] * 5, None), (300, [0.1, nan, 0.0, 0.0, 0.0], 1), (400, [inf, 0.0, 0.0, 0.0, 0.0], 1), (500, [None, 0.0, 0.0, 0.0, 0.1], 1),
                             (None, [0.3] * 5, 1), (600, [], 1), (700, [0.5, 0.5], 2), (20, [0.1] * 5, 3), (7, made(60, 5, 1)[7][1], made(60, 5, 1)[7][2]),
                             (800, [4e6, 4e6, 4e6, 4e6, 4e6], 2), (801, [4e6, 3e6, 4e6, 4e6, 4e6], 2), (802, [3e6, 4e6, 4e6, 0.0, 4e6], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("id", "vector", "tile", "grp", "bucket", "number", "score")})
    got = bond.hard_negatives(frame, F.col("id") % 20 == 0, tile_rows=16, group_anchors=2)
    assert result(got) == brute(rows, lambda i: i % 20 == 0)
    assert bond.hard_negatives(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_scores_beyond_63_bits():
    big = np.full((2, 3), 1 << 60, np.int64)
    tile = bond.Tile({"ids": [1, 2, 3], "labels": [0, 0, 0], "width": 8, "dims": 2, "columns": big.tobytes()})
    (first, *_) = bond.positives_in(tile, {"id": 9, "label": 0, "vector": [1 << 50, 1 << 50]}, 2)
    assert first == (1, 1 << 111)


def test_query_relabels(spark, write_tables):
    rows = made(800, 8, 5)
    folder = write_tables(embeddings=(SCHEMA, rows))
    want = brute(rows, lambda i: i % 100 == 0, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert result(queries.op11_bond_negatives(spark, folder)) == want and want
