import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.rank import ranked
from lodestone.llm import merkle, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, small=False):
    text = row[1].translate({c: c + 32 for c in range(65, 91)}) if small and row[1] is not None else row[1]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes, fanout=16):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout=16):
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        run = level[first:first + fanout]
        out.append((i - first, run[:i - first] + run[i - first + 1:]))
        i //= fanout
    return out


def expected(rows, fanout=16):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in groups[s]], fanout) for s in sources}
    top = tree([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            steps = way(trees[s], i, fanout) + way(top, k, fanout)
            digest = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for place, others in steps:
                digest = sha("".join(others[:place]) + digest + "".join(others[place:]))
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join("".join(o) for _, o in steps)), digest, digest == top[-1][0]))
    return out


def made(spark, rows, fanout, height):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    low, high = merkle.dataset_manifest(docs, changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout=fanout, height=height,
                                        altered={"text": F.translate("text", queries.CAPITALS, queries.SMALL)})
    return low, high


ROWS = [(i, f"Text {i}", "en", "hot", 6) for i in range(70)] + [(i, None, None, None, None) for i in range(100, 104)] + [
    (200, "", "de", "", 0), (201, "Ä A", "de", "é", 3), (201, "Ä A", "de", "é", 3), (201, "other", "de", "é", 3), (None, "Null Id", "de", "z", 7)]


@pytest.mark.parametrize("fanout, height", [(16, 3), (4, 1), (2, 3)])
def test_roots_proofs_and_folds(spark, fanout, height):
    low, high = made(spark, ROWS, fanout, height)
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in merkle.prove(low, high).collect()]
    assert sorted(got, key=repr) == sorted(expected(ROWS, fanout), key=repr)
    assert len(low.tiers) == {16: 1, 4: 4, 2: 3}[fanout]


def test_siblings_on_request(spark):
    low, high = made(spark, ROWS, 4, 2)
    for r in merkle.prove(low, high, with_siblings=True).collect():
        assert sha(bytes(r.siblings).hex()) == r.proof


@pytest.mark.parametrize("levels, fanout", [(1, 16), (2, 16), (4, 16), (5, 3), (7, 2)])
def test_layout_is_a_permutation_with_contiguous_subtrees(levels, fanout):
    whole = [merkle.address(d, np.arange(fanout ** d), levels, fanout) for d in range(levels)]
    assert sorted(np.concatenate(whole)) == list(range(merkle.size(levels, fanout)))
    top = levels // 2
    if top:
        assert sorted(np.concatenate(whole[:top])) == list(range(merkle.size(top, fanout)))
        for j in range(fanout ** top):  # each subtree below the cut, and again within it
            parts = [whole[d][j * fanout ** (d - top): (j + 1) * fanout ** (d - top)] for d in range(top, levels)]
            assert sorted(np.concatenate(parts)) == list(range(min(parts[0]), min(parts[0]) + merkle.size(levels - top, fanout)))


def test_single_document_and_empty_table(spark):
    one = [(5, "A", "en", "s", 1)]
    (row,) = merkle.prove(*made(spark, one, 16, 3)).collect()
    assert row.root == row.subroot == row.leaf == leaf(one[0]) and row.proof == sha("")
    assert merkle.prove(*made(spark, [], 16, 3)).count() == 0


def test_clashing_names(spark, corner):
    named = corner.withColumns({n: F.lit("x") for n in ("tree", "position", "digest", "payload", "block", "id", "other", "way", "under", "home")})
    low, high = merkle.dataset_manifest(named)
    assert merkle.prove(low, high).count() == corner.count()


def test_query_and_long_text(spark, write_tables):
    rows = ROWS + [(300, "Long Text " * 50000, "en", "hot", 500000)]
    folder = write_tables(documents=(COLUMNS, rows))
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, folder).collect()), key=repr) == sorted(expected(rows), key=repr)


def test_positions_are_dense(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "g", i // 50) for i in range(500)], "grp string, v int").repartition(5)
    for groups in (["grp"], []):
        got = ranked(rows, groups, [F.col("v")]).collect()
        for key in {r.grp for r in got} if groups else {0}:
            mine = sorted((r.position, r.v) for r in got if not groups or r.grp == key)
            assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert ranked(rows.limit(0), ["grp"], [F.col("v")]).count() == 0
    with pytest.raises(ValueError):
        ranked(rows, [], [F.col("v")], "grp")
