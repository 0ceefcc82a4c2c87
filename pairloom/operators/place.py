"""Places of rows in an order, over all partitions, without a sort in one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS = 33


def numbered(rows: DataFrame, *order: str, name: str = "rk") -> DataFrame:
    """rows with their 0-based place in the order, which must leave no ties.

    Ranges are sorted; a row's place is the number of rows in the ranges before and its place in its
    own. The sorted rows are read twice and kept for that, as another run might cut other ranges; what
    an executor takes along when it is lost is computed again from the same ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return _placed(ranges.persist(StorageLevel.MEMORY_AND_DISK), name)


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """rows (_at, ...) with places instead of _at: partition numbers above _BITS bits, places in the partition below."""
    part = F.shiftright(F.col("_at"), _BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row a partition.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_at", "_part", "_before")


def numbered_within(rows: DataFrame, group: list[str], ident: str, name: str) -> DataFrame:
    """rows with their 0-based place in the order of ident within their group; groups are few, and of any size."""
    placed = numbered(rows, *group, ident, name="_rk")
    first = placed.groupBy(*group).agg(F.min("_rk").alias("_first"))
    return placed.join(F.broadcast(first), group).withColumn(name, F.col("_rk") - F.col("_first")).drop("_rk", "_first")
