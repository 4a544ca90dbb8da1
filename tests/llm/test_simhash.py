import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import queries, simhash

from .conftest import SMALL


def plain_fingerprint(text, width=4):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i: i + width]) for i in range(max(len(parts) - width + 1, 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    f, inverse = np.unique(np.array(prints, np.uint64), return_inverse=True)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    label = simhash.roots(np.stack([a, b]), len(f))[inverse]
    frame = pd.DataFrame({"id": ids, "root": label})
    return frame.groupby("root").id.transform("min").tolist()


def test_query_against_brute_force(spark, documents):
    rows = documents.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components([r.doc_id for r in rows], prints))}
    assert {tuple(r) for r in queries.op5_simhash(spark, SMALL).collect()} == want


def test_links_at_the_radius_and_through_others(spark):
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 63, 400, np.uint64)
    chain = [base[0]]
    for step in range(12):  # each four bits from the one before
        chain.append(chain[-1] ^ np.uint64(0b1111 << (4 * step)))
    near = [base[1] ^ np.uint64(0b11111), base[2] ^ np.uint64(0b1001001001)]
    values = np.unique(np.concatenate([base, chain, near]).astype(np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "node long").select("node", F.array("node").alias("fp"))
    got = simhash.star_components(simhash.block_links(nodes, len(values), 4)).collect()
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    label = simhash.roots(np.stack([a, b]), len(values))
    want = {}
    for k, root in enumerate(label.tolist()):
        want.setdefault(root, set()).add(int(values.view(np.int64)[k]))
    found = {}
    for r in got:
        found.setdefault(r.root, {r.root}).add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_more_blocks_and_tiles_lose_nothing(spark, monkeypatch):
    random = np.random.default_rng(2)
    base = np.uint64(random.integers(0, 1 << 63))
    flips = [base ^ np.uint64(sum(1 << int(b) for b in random.choice(64, 5, replace=False))) for _ in range(300)]
    values = np.unique(np.array(flips, np.uint64))
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    want = len(set(simhash.roots(np.stack([a, b]), len(values)).tolist()))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "node long").select("node", F.array("node").alias("fp"))
    monkeypatch.setattr(simhash, "TILE", 16)
    for n in (len(values), 10 ** 9):
        blocks, _ = simhash.block_plan(n, 4)
        joined = simhash.star_components(simhash.block_links(nodes, n, 4))
        assert len(values) - joined.count() == want, blocks


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in simhash.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 201: 200}
    assert simhash.star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def runs(text, width=5):
    words = text.split()
    return {tuple(words[i: i + width]) for i in range(max(len(words) - width + 1, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_one_of_each_group_stays(documents):
    rows = {r.doc_id: runs(r.text) for r in documents.collect()}
    kept = {r.doc_id for r in simhash.keep_one(documents).collect()}
    left = sorted(kept)
    for k, a in enumerate(left):
        assert not any(jaccard(rows[a], rows[b]) >= 0.85 for b in left[k + 1:])
    for gone in set(rows) - kept:
        assert max(jaccard(rows[gone], rows[b]) for b in rows if b != gone) >= 0.5


def test_what_goes_has_a_partner_at_the_limit_and_what_stays_has_none(spark, monkeypatch):
    random = np.random.default_rng(3)
    rows = []
    for group in range(40):  # 100 shingles; k words replaced at one end leave (100 - k) of (100 + k) in common: 0.8 up to k = 11
        words = [f"g{group}w{int(w)}" for w in random.permutation(104)]
        rows += [(3 * group, " ".join(words)), (3 * group + 1, " ".join(words[: 104 - 5 - group % 20] + [f"g{group}x{k}" for k in range(5 + group % 20)]))]
        rows.append((3 * group + 2, " ".join(words * 3)))  # 104 distinct shingles, 100 of them the first row's
    rows += [(1000 + k, " ".join(["one two three four five six seven", "eight", f"n{k}"])) for k in range(5)]  # four of six in common
    rows += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i"), (2002, "A  b c d e f g h")]  # four of five; the same set
    sets = {i: runs(t.lower()) for i, t in rows}
    ids = sorted(sets)
    pairs = np.array([(x, y) for x in range(len(ids)) for y in range(x) if jaccard(sets[ids[x]], sets[ids[y]]) >= 0.8]).T
    want = sorted({ids[r] for r in simhash.roots(pairs, len(ids)).tolist()})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want
    monkeypatch.setattr(simhash, "SET_TILE", 100)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_stage_against_brute_force_at_the_limit(documents):
    rows = {r.doc_id: runs((r.text or "").lower()) for r in documents.collect()}
    ids = sorted(rows)
    pairs = [(x, y) for x in range(len(ids)) for y in range(x) if jaccard(rows[ids[x]], rows[ids[y]]) >= 0.8]
    label = simhash.roots(np.array(pairs, int).reshape(-1, 2).T, len(ids))
    assert {r.doc_id for r in simhash.keep_one(documents).collect()} == {ids[r] for r in label.tolist()}


def test_corner_cases(corner, nothing):
    got = simhash.near_duplicates(corner)
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == corner.count()
    by_id = {r.doc_id: r.component_id for r in got.collect()}
    assert by_id[8] == 1 and by_id[3] == by_id[5] == 2 and by_id[None] is None
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(corner)
    assert kept.columns == corner.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 7]
