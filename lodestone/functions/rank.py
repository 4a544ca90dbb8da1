"""Dense positions in a global order, without a single-task sort.

Rows are range partitioned and sorted, the sorted partitions are written once, and each partition's part of a group gets an offset
from the counts of the partitions before it. What is joined back has one row per partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each group in the given order; no two rows share a position.

    Null group keys form groups of their own. Rows the order does not tell apart keep the order they were read in, which spreads a
    large set of equal rows over partitions. An empty frame stays empty. ``name`` must be no column of ``df``.
    """
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    keys = [F.col(f"`{g}`") for g in groups]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*keys, *order, F.col("_tie")).sortWithinPartitions(*keys, *order, F.col("_tie")).drop("_tie")
    placed = cut_lineage(placed).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    parts = placed.groupBy("_part", *groups).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    # One row per partition and group: the window of the largest group has as many rows as there are partitions.
    offsets = parts.select("_part", "_first", *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)],
                           (F.coalesce(F.sum("_rows").over(before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                            - F.col("_first")).alias("_offset"))
    same = placed["_part"] == offsets["_part"]
    for i, g in enumerate(groups):
        same = same & placed[f"`{g}`"].eqNullSafe(offsets[f"_g{i}"])
    return placed.join(offsets, same).select(*[placed[f"`{c}`"] for c in df.columns], (F.col("_place") + F.col("_offset")).alias(name))
