import random
import re

import numpy as np

from lodestone.llm import queries, tiling

from .conftest import SMALL


def plain_tiles(pattern, text, least):
    """Greedy string tiling by trying every pair of positions."""
    p_free, t_free, tiles = [True] * len(pattern), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and p_free[p + n] and t_free[t + n] and pattern[p + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return tiles
        tiles.append(tiling.Tile(p, t, n))
        for k in range(n):
            p_free[p + k] = t_free[t + k] = False


def test_tiles_cover_as_much_as_plain_tiling():
    random.seed(3)
    for _ in range(60):
        pattern = [random.randrange(6) for _ in range(random.randrange(1, 40))]
        text = [random.randrange(6) for _ in range(random.randrange(1, 60))] + pattern[10:25] + pattern[:8]
        got, want = tiling.greedy_tiles(pattern, text, 3, start=8), plain_tiles(pattern, text, 3)
        assert sorted(t.length for t in got)[-1:] == sorted(t.length for t in want)[-1:]
        for t in got:
            assert pattern[t.item_at: t.item_at + t.length] == text[t.doc_at: t.doc_at + t.length] and t.length >= 3
        marks = [k for t in got for k in range(t.item_at, t.item_at + t.length)]
        assert len(marks) == len(set(marks)) and sum(t.length for t in got) >= 0.9 * sum(t.length for t in want)


def test_query_against_plain_tiling(spark, documents):
    numbers = {}
    words = lambda t: [numbers.setdefault(w, len(numbers)) for w in re.findall(r"\w+", (t or "").lower())]
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = set()
    for r in documents.collect():
        text = words(r.text)
        runs = {tuple(text[k: k + 5]) for k in range(len(text) - 4)}
        for item, pattern in items.items():
            if any(tuple(pattern[k: k + 5]) in runs for k in range(len(pattern) - 4)):
                if sum(t.length for t in tiling.greedy_tiles(pattern, text, 5)) >= 0.5 * len(pattern):
                    want.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in queries.op2_string_tiling(spark, SMALL).collect()}
    assert got == want and want


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_reordered_and_partial_passages(spark):
    reordered = " ".join(ITEM[10:] + ["filler"] * 30 + ITEM[:10])
    docs = spark.createDataFrame([(1, f"before {reordered} after"), (2, " ".join(ITEM[:6]) + " other words follow here"), (3, "nothing in common at all"),
                                  (4, " ".join(ITEM).upper() + "!")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(ITEM)), (8, "too short"), (9, None), (9, None)], "item_id long, text string")
    got = {r.doc_id: r for r in tiling.leaks(docs, bench, block_bytes=100).collect()}
    assert set(got) == {1, 4} and got[1].coverage == 1.0 and len(got[1].tiles) == 2 and got[1].item_id == 7
    assert sorted(r.doc_id for r in tiling.decontaminate(docs, bench, block_bytes=100).collect()) == [2, 3]


def test_corner_cases(spark, corner, nothing):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in tiling.leaks(corner, bench).collect()) == [1, 1, 8]
    kept = tiling.decontaminate(corner, bench)
    assert kept.columns == corner.columns and kept.count() == corner.count() - 3
    assert tiling.leaks(nothing, bench).count() == 0 and tiling.leaks(corner, bench.limit(0)).count() == 0
    assert tiling.decontaminate(corner, bench.limit(0)).count() == corner.count()


def test_window_hashes_tell_windows_apart():
    tokens = np.arange(50, dtype=np.uint64)
    assert len(set(tiling.window_hashes(tokens, 5).tolist())) == 46 and len(tiling.window_hashes(tokens[:3], 5)) == 0
