import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import queries, repeats

from .conftest import SMALL


def brute(texts, width):
    """(bytes, removed flags) per text from a count of all strings."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k: k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone, last = np.zeros(len(d), bool), 0
        for k in range(len(d) - width + 1):
            if count[d[k: k + width]] > 1:
                gone[max(k, last): k + width] = True
                last = k + width
        out.append((d, gone))
    return out


def digest(data, gone):
    edges = np.diff(np.concatenate([[0], gone.astype(int)]))
    return len(data), int(gone.sum()), int((edges > 0).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def test_query_against_brute_force(spark, documents):
    rows = documents.collect()
    want = {(r.doc_id, *digest(*w)) for r, w in zip(rows, brute([r.text for r in rows], 200))}
    assert {tuple(r) for r in queries.op7_repeated_bytes(spark, SMALL).collect()} == want


@pytest.mark.parametrize("modulus", [1, 7, 13])
def test_random_repeats_within_and_across_texts(spark, modulus):
    random.seed(modulus)
    parts = ["".join(random.choices("ab", k=random.randrange(5, 60))) for _ in range(12)]
    texts = ["".join(random.choices([*parts, "x", "é", "yz"], k=random.randrange(0, 12))) for _ in range(80)] + [None, "", "a" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, width=20, modulus=modulus, group_bytes=700).collect()}
    for k, (data, gone) in enumerate(brute(texts, 20)):
        assert got[k].n_bytes == len(data) and bytes(got[k].kept) == np.frombuffer(data, np.uint8)[~gone].tobytes(), k
        assert sum(s.end - s.start for s in got[k].spans) == gone.sum()


def test_covers_hold_every_difference():
    for v in (1, 2, 7, 13, 50, 133):
        cover = repeats.difference_cover(v)
        assert len({(a - b) % v for a in cover.tolist() for b in cover.tolist()}) == v


def test_corner_cases(corner, nothing):
    got = repeats.remove_repeats(corner, width=40, modulus=13)
    assert got.count() == corner.count() and got.where("doc_id is null").count() == 1
    assert {bytes(r.kept) for r in got.where("doc_id = 1").collect()} == {b""}
    assert repeats.remove_repeats(nothing).count() == 0
