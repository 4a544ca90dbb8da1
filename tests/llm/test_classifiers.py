"""Quality and toxicity: held-out accuracy, folds, and rows that are hard on classifiers."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fm, queries, toxicity

from .conftest import MIDDLE


def area(truth, score):
    truth, rank = np.array(truth), np.argsort(np.argsort(score))
    good = truth == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def held_out(spark, query, label):
    return query(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").select(label, "score", "predicted").collect()


def test_quality_of_held_out_rows(spark):
    rows = held_out(spark, queries.op10_factorisation_machine, "quality")
    assert area([r.quality for r in rows], [r.score for r in rows]) > 0.9
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.9


def plain_tables(write_tables, n=1500):
    """Texts of random words, toxic ones with a few words of their own."""
    random.seed(5)
    words = ["".join(random.choices("abcdefghij", k=4)) for _ in range(4000)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(random.random() < 0.3)
        text = [random.choice(words) for _ in range(random.randrange(20, 120))]
        for _ in range(len(text) // 12 + 1 if toxic else 0):
            text[random.randrange(len(text))] = random.choice(["vile", "scoundrel", "wretch"])
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1 - toxic, toxic))
    return write_tables(documents=("doc_id long, text string, lang string, source string, n_chars long", docs),
                        labels=("doc_id long, quality int, toxic int", labels)), labels


def test_toxicity_of_held_out_rows(spark, write_tables):
    folder, labels = plain_tables(write_tables)
    rows = queries.op3_toxicity(spark, folder).collect()
    assert len(rows) == len(labels) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {i: t for i, _, t in labels}
    away = [r for r in rows if r.held_out]
    assert area([truth[r.doc_id] for r in away], [r.score for r in away]) > 0.97
    assert np.mean([truth[r.doc_id] == r.predicted for r in away]) > 0.93


@pytest.mark.parametrize("query, label, modulus, fold", [("op3_toxicity", "toxic", 5, 0), ("op10_factorisation_machine", "quality", 3, 1)])
def test_labels_of_the_held_out_fold_change_nothing(spark, write_tables, query, label, modulus, fold):
    folder, labels = plain_tables(write_tables, 400)
    turned = [(i, q, t) if zlib.crc32(str(i).encode()) % modulus != fold else (i, 1 - q, 1 - t) for i, q, t in labels]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    other = write_tables(documents=(docs.schema, docs.collect()), labels=("doc_id long, quality int, toxic int", turned))
    run = lambda f: {r.doc_id: round(r.score, 9) for r in queries.QUERIES[query][0](spark, f).collect()}
    assert run(folder) == run(other)


def test_pair_sum_equals_all_pairs():
    random_numbers = np.random.default_rng(3)
    buckets, rank = 32, 3
    size = fm.STATISTICS + buckets + 1
    machine = fm.Machine(random_numbers.normal(size=size), random_numbers.normal(size=(size, rank)), np.zeros(fm.STATISTICS), np.ones(fm.STATISTICS))
    x = fm.Sparse(random_numbers.normal(size=(2, fm.STATISTICS)), np.array([0, 0, 1]), np.array([20, 30, 25]), np.array([0.5, 2.0, 1.5]))
    got, _, _ = fm.raw_score(x, machine)
    for row in range(2):
        full = np.zeros(size)
        full[: fm.STATISTICS] = np.clip(x.dense[row], -6, 6)
        full[x.column[x.row == row]] = x.value[x.row == row]
        pairs = sum(machine.factors[i] @ machine.factors[j] * full[i] * full[j] for i in range(size) for j in range(i + 1, size))
        assert abs(got[row] - (machine.linear[-1] + full @ machine.linear + pairs)) < 1e-8


def test_unseen_words_say_nothing_about_toxicity():
    cell = np.array([5, 6, 7])
    ratio = toxicity.ratios(cell, np.array([50.0, 0, 30]), np.array([0.0, 20, 10]), np.array([30.0, 10, 25]))
    assert ratio[6] > 1 and ratio[5] < 0 and ratio[1000] == 0


@pytest.mark.parametrize("module, label", [(fm, "quality"), (toxicity, "toxic")])
def test_corner_cases(spark, corner, nothing, module, label):
    kinds = f"doc_id long, {label} int, text string, score int"
    labels = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "x", 1), (2, 0, None, 1), (4, 0, None, None), (None, 1, "y", 2), (7, None, "z", 3), (99, 1, "", 1)], kinds)
    model = module.fit(corner, labels, label)
    out = module.score(corner, model)
    assert out.count() == corner.count() and sorted(out.columns) == sorted(corner.columns)
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert module.score(nothing, model).count() == 0
    assert module.fit(nothing, labels, label) is None and module.fit(corner, labels.limit(0), label) is None
    assert {r.score for r in module.score(corner, None).collect()} == {0.5}
    assert out.where(F.col("text") == "").count() == 1
