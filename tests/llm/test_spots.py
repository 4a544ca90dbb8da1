import hashlib
import re

from lodestone.llm import queries, spots

from .conftest import SMALL


def plain_signatures(text):
    words = re.findall(r"[^\W_]+", text.lower())
    found = set()
    for k, w in enumerate(words):
        if w in spots.ANCHORS:
            chain = []
            while len(chain) < spots.CHAIN and k + 1 + len(chain) < len(words) and words[k + 1 + len(chain)] not in spots.ANCHORS:
                chain.append(words[k + 1 + len(chain)])
            if chain:
                found.add(" ".join([w, *chain]))
    return found or ({" ".join(words) or text} if text else set())


def likeness(a, b):
    a, b = plain_signatures(a), plain_signatures(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in queries.op4_spot_signatures(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, other = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(g.near_edited - likeness(text, edited)) < 1e-12 and abs(g.near_next - likeness(text, other)) < 1e-12
    prints = {}
    for r in rows:
        assert prints.setdefault(r.text, got[r.doc_id].fingerprint) == got[r.doc_id].fingerprint


def test_next_row_with_gaps_ties_and_missing_ids(spark):
    rows = [(5, "e"), (9000000, "z"), (5, "e2"), (-3, "m"), (None, "n"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for count in (1, 3, 50):
        got = {(r.doc_id, r.text): r.next_text for r in spots.with_next(docs, count=count).collect()}
        assert len(got) == 6 and got[(9000000, "z")] == "" and got[(-3, "m")] == "n" and got[(None, "n")] == "z"
        assert got[(7, "")] in ("e", "e2") and {got[(5, "e")], got[(5, "e2")]} in ({"e", "m"}, {"e2", "m"})


def test_near_pairs_lose_nothing(spark, documents):
    rows = documents.collect()
    extra = [(10_000 + r.doc_id, " ".join((r.text or "").split()[:-3])) for r in rows[:60]] + [(20_000 + r.doc_id, r.text) for r in rows[:20]]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + extra, "doc_id long, text string")
    marked = spots.spot_signatures(docs)
    class_of = {r.doc_id: r.class_id for r in spots.classes(marked).collect()}
    sets = {}
    for r in marked.collect():
        sets[class_of[r.doc_id]] = set(r.signatures)
    keys = sorted(k for k in sets if sets[k])
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    got = {(r.a, r.b) for r in spots.near_pairs(marked).collect()}
    assert got == want and want


def test_corner_cases(corner, nothing):
    marked = {(r.doc_id, len(r.signatures)) for r in spots.spot_signatures(corner).collect()}
    assert {(2, 0), (3, 0), (5, 1), (6, 1), (7, 1)} <= marked
    assert spots.with_next(corner).count() == corner.count() and spots.with_next(nothing).count() == 0
    assert spots.near_pairs(spots.spot_signatures(nothing)).count() == 0
