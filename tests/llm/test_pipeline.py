import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import fm, queries, simhash, surrogates, tiling
from lodestone.llm.text import held_out

from .conftest import SMALL


def test_stages_in_their_order(spark, documents):
    """Each stage against what its operator says about the rows its predecessor kept."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "personal data", "packing"]
    docs = documents
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        kept.append(docs)
    assert all(k.columns == documents.columns for k in kept[:-1])
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept[:-1]]
    machine = fm.fit(documents, queries.table(spark, SMALL, "labels").where(~held_out("doc_id", 3, 1)), "quality")
    assert set(ids[0]) == {r.doc_id for r in fm.score(documents, machine).where("score >= 0.5").collect()}
    assert set(ids[1]) == {r.doc_id for r in simhash.keep_one(kept[0]).collect()} and len(ids[1]) == len(set(ids[1]))
    leaked = {r.doc_id for r in tiling.leaks(kept[1], queries.table(spark, SMALL, "benchmark")).collect()}
    assert leaked and set(ids[2]) == set(ids[1]) - leaked
    assert sorted(ids[3]) == sorted(ids[2])
    assert kept[3].where(F.col("n_chars") != F.length("text")).count() == 0
    assert surrogates.pseudonymise(kept[2], "key").where("n_mentions > 0").count() > 0
    pieces = kept[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert sorted(r.doc_id for r in pieces) == sorted(ids[3]) and all(r.n == r.t for r in pieces)


def test_run_gives_the_last_stage(spark, documents):
    out = corpus_pipeline.run(spark, SMALL)
    again = corpus_pipeline.run(spark, SMALL)
    keys = lambda df: sorted((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in df.collect())
    first = keys(out)
    assert first and [k[0] for k in first] == sorted(k[0] for k in first)
    assert {k[0] for k in first} == {k[0] for k in keys(again)} and corpus_pipeline.ORACLE_SQL is None


def test_corner_cases(spark, corner, nothing, write_tables):
    labels = ("doc_id long, quality int, toxic int", [(1, 1, 0), (3, 0, 0), (4, 1, 0)])
    folder = write_tables(labels=labels, benchmark=("item_id long, text string", [(1, "the house that the other people built long ago")]))
    for docs in (corner, nothing):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, folder)
            assert docs.count() <= 10_000_000 and (stage is corpus_pipeline.packing or docs.columns == before.columns)
