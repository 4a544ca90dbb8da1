import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import packing, queries

from .conftest import SMALL


def tokens(texts):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(e.ids + [0], "<u4") for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def padding(lengths, capacity=1024):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def check(rows, docs):
    """Every id lies in exactly one piece, pieces hold the document's ids, sequences are gapless and within the capacity."""
    ids = dict(zip([d for d, _ in docs], tokens([t for _, t in docs])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(ids[doc][at: at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    used = [sum(p.length for p in pieces) for pieces in by_sequence.values()]
    assert padding(used) <= 0.01 * sum(used)


def test_query_against_the_tokenizer(spark, documents):
    check(queries.op1_harmonic_packing(spark, SMALL).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_special_tokens_in_a_text_are_text(write_tables, spark):
    rows = [(1, "a <|endoftext|> b", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1)]
    folder = write_tables(documents=("doc_id long, text string, lang string, source string, n_chars long", rows))
    check(queries.op1_harmonic_packing(spark, folder).collect(), [(r[0], r[1]) for r in rows])


def test_classes_hold_a_fixed_number_of_pieces():
    assert packing.cuts(1024 + 700, 1024, 64) == [1024, 512, 128, 60]
    bins = packing.Bins(1024, 64, 0)
    for doc in range(17):
        bins.add(doc, np.zeros(60, "<u4"))
    assert len(bins.drain()) == 17 and not bins.open
    bins.add(99, np.zeros(700, "<u4"))
    bins.finish()
    lengths = defaultdict(int)
    for row in bins.drain():
        lengths[row[5]] += row[2]
    assert padding(lengths.values()) == 0


def test_corner_cases(corner, nothing):
    out = queries.pack_documents(corner)
    assert out.select(F.sum("length")).first()[0] == sum(len(t) for t in tokens([r.text for r in corner.collect()]))
    assert queries.pack_documents(nothing).collect() == []


def test_added_tokens_within_a_text(spark, write_tables):
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "<|endoftext|", "<|ENDOFTEXT|>"]
    folder = write_tables(documents=("doc_id long, text string", list(enumerate(texts))))
    check(queries.op1_harmonic_packing(spark, folder).collect(), list(enumerate(texts)))
    assert 50256 in tokens(texts)[0]
