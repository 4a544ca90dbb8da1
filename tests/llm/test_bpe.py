import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, queries

VOCABULARY = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "it's we'll 'Sfoo''s\r\n\r\n", "  \n x\t\x1c\x1f y z ", " " * 700 + "x" * 30000, "é日本語 \U0001F600‍ naïve１２", "The cat. The cat! the cat",
         # letters and digits of a Unicode version that only one of the two libraries knows
         "aࢉbࢊ x࢏՘ \U00011de0\U00011de011 '՘s \U0001FAE9"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(struct.pack("<I", i) for i in ids)


def test_ids_are_those_of_the_library(spark, library, corner):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(corner.select("doc_id", "text"))
    for size in (1, 60, 1 << 20):
        coded = bpe.encode(docs.repartition(3), VOCABULARY, P.PATTERN, block_bytes=size, range_bytes=3000)
        got = sorted((repr(r.doc_id), bytes(r.ids)) for r in coded.collect())
        assert got == sorted((repr(r.doc_id), packed(library.encode_ordinary(r.text or ""))) for r in docs.collect())


def test_equal_words_meet_and_are_sent_once_per_block(spark):
    docs = spark.createDataFrame([(i, "same same words again") for i in range(50)], "doc_id long, text string")
    docs = docs.repartition(4)
    assert bpe.positions_of(docs, P.PATTERN, 60).count() > 4
    ranges: dict[bytes, set] = {}
    for r in bpe.parts_of(docs, P.PATTERN, 60, 3).collect():
        words = bpe.cut(bpe.spread(r.words, r.word_bytes), bpe.numbers(r.sizes, r.n_words))
        assert len(set(words)) == len(words)
        for w in words:
            ranges.setdefault(w, set()).add(r.range)
    assert sorted(ranges) == [b" again", b" same", b" words", b"same"] and all(len(r) == 1 for r in ranges.values())


def test_readings_that_differ_are_noticed(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.udf(lambda i: __import__("uuid").uuid4().hex, "string").asNondeterministic()("id").alias("text"))
    with pytest.raises(Exception, match="two readings"):
        bpe.encode(docs, VOCABULARY, P.PATTERN).collect()


def test_decoding_gives_the_bytes_back(spark, library):
    rows = [(i, packed(library.encode_ordinary(t or ""))) for i, t in enumerate(TEXTS)] + [(None, None), (90, packed([0, 50256])), (91, packed([0, 1]))]
    coded = spark.createDataFrame(rows, "doc_id long, ids binary")
    for size in (1, 1 << 20):
        got = {r.doc_id: r.decoded for r in bpe.decode(coded.coalesce(1), VOCABULARY, batch_bytes=size).collect()}
        assert [bytes(got[i]).decode() for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
        assert got[None] == b"" and got[90] is None and got[91] == library.decode_bytes([0, 1])


def test_empty_table_and_clashing_names(spark, corner, nothing):
    assert bpe.decode(bpe.encode(nothing, VOCABULARY, P.PATTERN), VOCABULARY).count() == 0
    named = corner.withColumns({n: F.lit("x") for n in ("block", "ids", "word", "place", "token", "bytes", "docs")})
    assert bpe.encode(named, VOCABULARY, P.PATTERN).count() == corner.count()


def test_vocabulary_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_VOCABULARY_BYTES", 100)
    with pytest.raises(ValueError):
        bpe.token_bytes(spark, VOCABULARY)


def test_query_against_the_library(spark, library, write_tables):
    folder = write_tables(documents=("doc_id long, text string, source string", [(i, t, "s") for i, t in enumerate(TEXTS)]))
    got = sorted(map(tuple, queries.op12_byte_bpe(spark, folder).collect()))
    want = [(i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in enumerate(TEXTS) for ids in [library.encode_ordinary(t or "")]]
    assert got == want


def test_a_block_is_gone_before_the_next_is_built(monkeypatch):
    import gc
    import weakref

    import pyarrow as pa

    alive = []

    class Watched(bpe.Block):
        def __init__(self, *args):
            gc.collect()
            assert not any(r() is not None for r in alive)
            super().__init__(*args)
            alive.append(weakref.ref(self))

    monkeypatch.setattr(bpe, "Block", Watched)
    monkeypatch.setattr(bpe.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2], "text": ["one two", "three four", "five"]})
    made = bpe.blocks(iter([batch]), P.PATTERN, {}, 1)
    for _ in range(3):
        block = next(made)
        assert block.words
        if len(alive) < 3:
            assert not made.gi_frame.f_locals["waiting"]  # nor are its texts held while it is read
        del block
    assert len(alive) == 3
