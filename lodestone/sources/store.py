"""Tables on disk: parquet partitioned by repository and snapshot, comparisons by repository and both snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import vocab

KEYS = vocab.KEYS
COMPARED = [vocab.REPO, "baseline_snapshot_id", "target_snapshot_id"]


def keys_of(columns: list[str]) -> list[str]:
    """Partition columns of a table: those of a comparison where it has both snapshots."""
    return COMPARED if set(COMPARED) <= set(columns) else KEYS


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace exactly the snapshots or comparisons present in ``df``; writing the same rows again changes nothing.

    Rows are rebalanced by key first: a large snapshot is split over tasks, small ones share one, so files are few.
    """
    keys = keys_of(df.columns)
    (df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
     .parquet(f"{root.rstrip('/')}/{name}"))


def read_table(spark: SparkSession, root: str, name: str, repository_id: str | None = None, snapshot_id: str | None = None,
               baseline_snapshot_id: str | None = None, target_snapshot_id: str | None = None) -> DataFrame:
    """A stored table, pruned to a repository, snapshot or comparison where given; keys stay strings."""
    path = f"{root.rstrip('/')}/{name}"
    found = spark.read.parquet(path).schema
    keys = keys_of(found.names)
    df = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in found])).parquet(path)
    wanted = {vocab.REPO: repository_id, vocab.SNAP: snapshot_id, COMPARED[1]: baseline_snapshot_id, COMPARED[2]: target_snapshot_id}
    for key, value in wanted.items():
        if value is not None:
            df = df.where(F.col(key) == value)
    return df
