"""Dense ranks without a task that sees all rows: ranks inside range partitions plus what lies before each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.plans.store import materialize


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``rows`` and the column ``name``: their place from 0 in the given order, as a written table.

    Rows that the order doesn't tell apart get places in no particular order among themselves.  The ranges of equal length
    come from Spark's sample; each is sorted by one task, and only one number a range is added up in one place.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    placed = materialize(placed, "placed")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    offsets = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def carried(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """``rows`` and the column ``name``: the last ``value`` that isn't null in an earlier row of the same key, in the given order; a written table.

    descending: in a later row instead, the nearest one.  Key columns mustn't be null.  A key's rows may lie in many range partitions: each
    looks inside itself, and what its first key brings along from before is found from one row a partition.
    """
    by = [(F.desc(c) if descending else F.asc(c)) for c in (*key, *order)]
    inner = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    earlier = Window.partitionBy("_part", *key).orderBy(*by[len(key) :]).rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(inner.withColumn("_own", F.last(value, ignorenulls=True).over(earlier)), "placed")
    keys, place = F.struct(*key), F.struct(*order)
    first = F.max if descending else F.min
    last = F.min if descending else F.max
    held = placed.where(F.col(value).isNotNull()).groupBy("_part").agg((F.min_by if descending else F.max_by)(F.struct(keys.alias("k"), F.col(value).alias("v")), F.struct(keys, place)).alias("held"))
    parts = placed.groupBy("_part").agg(first(keys).alias("first"), last(keys).alias("last")).join(held, "_part", "left")
    before = F.last(F.when(F.col("held.k") == F.col("last"), F.col("held")), ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    brought = parts.withColumn("brought", before).where(F.col("brought.k") == F.col("first")).select("_part", *[F.col("first")[c].alias(c) for c in key], F.col("brought.v").alias("_brought"))
    out = placed.join(F.broadcast(brought), ["_part", *key], "left")
    return materialize(out.select(*rows.columns, F.coalesce("_own", "_brought").alias(name)), "carried")


def running(rows: DataFrame, key: str, order: list, value: str, name: str) -> DataFrame:
    """``rows`` and the column ``name``: the sum of ``value`` over the earlier rows of the same key, in the given order of columns; a written table.

    As in :func:`carried`, a key may fill many range partitions: what lies before a partition is added up from one row a partition.
    """
    by = [F.col(key), *[F.col(c) if isinstance(c, str) else c for c in order]]
    inner = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    earlier = Window.partitionBy("_part", key).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(inner.withColumn("_own", F.coalesce(F.sum(value).over(earlier), F.lit(0))), "placed")
    sums = placed.groupBy("_part", key).agg(F.sum(value).alias("sum"))
    parts = sums.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("sum", key).alias("sum"))  # one row a partition
    before = F.sum("sum").over(Window.partitionBy("last").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a partition's first key may be the last of earlier ones, whole partitions of it among them
    ends = parts.select("_part", F.col("last"), "sum").withColumn("upto", F.coalesce(before, F.lit(0)) + F.col("sum"))
    brought = parts.select("_part", F.col("first").alias(key)).join(ends.select(F.col("_part").alias("q"), F.col("last").alias(key), "upto"), key).where("q < _part")
    brought = brought.groupBy("_part", key).agg(F.max("upto").alias("_brought"))
    out = placed.join(F.broadcast(brought), ["_part", key], "left")
    return materialize(out.select(*rows.columns, (F.col("_own") + F.coalesce("_brought", F.lit(0))).alias(name)), "running")
