"""Running totals that don't put a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweb.session import checkpointed


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the group's rows up to this one, in ``order`` (a total order).

    Rows are range-partitioned by group and order, so a hot group covers many partitions; each partition's part of a group
    is summed by itself, and the sums of the parts before it (one row for each partition and group) are added.
    """
    keys = [F.col(c) for c in [*group, *order]]
    spread = [partitions] if partitions else []
    placed = df.withColumn("__value", value.cast("long")).repartitionByRange(*spread, *keys).withColumn("__part", F.spark_partition_id())
    placed = checkpointed(placed)
    within = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*group, "__part").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    renamed = offsets.select(F.col("__part").alias("__p"), "__before", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    match = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    summed = placed.withColumn("__own", F.sum("__value").over(within)).join(renamed, match)
    return summed.withColumn(name, F.col("__own") + F.col("__before")).select(*df.columns, name)


def numbered(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... over all rows in ``order``, without a single-task window."""
    one = df.withColumn("__all", F.lit(0))
    return running_total(one, ["__all"], order, F.lit(1), name, partitions).select(*df.columns, name)
