"""Gapless numbers over a sorted table, without a task that holds more than its range.

Rows are dealt by range and sorted within their partition; what a row needs
besides its place in the partition is the number of rows in the partitions
before it, a table of one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stored


def numbered(rows: DataFrame, order: list[str], number: str, part: str = "part") -> DataFrame:
    """The rows with ``number``, from 0 in ascending ``order`` (nulls first), and ``part``, their range.

    ``order`` must tell apart all rows that are not alike in every column used.
    The table is written once, so that ranges cannot be cut differently later.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    made = F.monotonically_increasing_id()
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_made", made), "numbered")
    # monotonically_increasing_id is (partition, row within it) in one number
    where = placed.select("*", F.shiftright("_made", 33).alias(part), F.col("_made").bitwiseAND((1 << 33) - 1).alias("_row"))
    sizes = where.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias("_start"))
    # one row for each partition of the table
    return where.join(F.broadcast(starts), part).select(*rows.columns, (F.col("_start") + F.col("_row")).alias(number), part)
