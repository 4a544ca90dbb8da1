"""The two snapshots of the module graph, grouped and paired as numbers, are those of the names."""
import random

import pytest

from lodestone.operators import evolution as E
from lodestone.operators import graph as GR
from lodestone.queries import findings as Q
from lodestone.sources import warehouse as W


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Few parts, so that edges repeat; every column has nulls, and numbers and flags no edge is named by."""
    rng, to = random.Random(3), str(tmp_path_factory.mktemp("lines"))

    def value(*of):
        return rng.choice([*of, *of, *of, None])

    rows = [(rng.randrange(9), value(0, 1, 21, 40), value(0, 1, 21), value(1, 2, 4, 8, 9), value("A", "N", "R"), value("F", "O")) for _ in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(
        f"{to}/lineitem.parquet")
    return to


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_links_named_are_the_strongest_edges(spark, lines):
    named = W.named_links(W.status_links(spark, lines))
    strongest = GR.strongest_edges(W.status_edges(spark, lines))
    assert bag(named) == bag(strongest.select(named.columns)) and named.count() < 400


@pytest.mark.parametrize("tasks", [1, 3])
def test_relationships_paired_by_number_equal_those_paired_by_name(spark, lines, tasks):
    edges = GR.strongest_edges(W.status_edges(spark, lines))
    by_name = E.relationship_diff(*Q._two(edges, W.status_pair(spark)))
    by_number = Q._status_rels(Q._status_links(spark, lines), tasks)
    assert bag(by_number) == bag(by_name.select(by_number.columns)) and by_number.where("resolution_changed").count()
