"""Complete-population checks without Cartesian joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every combination of two sets of distinct dimension values.

    The right side is numbered, each left row emits those numbers with a
    generator and the values come back with an equi-join, so the result (which
    is the requested roster itself) is produced in parallel and no side has to
    be broadcast or held by one task.
    """
    right = right.distinct()
    order = Window.orderBy(*right.columns)  # one dimension's distinct values
    numbered = right.select("*", F.row_number().over(order).alias("_i"))
    size = numbered.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return (
        left.distinct()
        .where(size > 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(1), size)))
        .join(numbered, "_i")
        .drop("_i")
    )


def grid_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on which two populations disagree: missing, unexpected, duplicate.

    One aggregate over the union of both sides; nothing is paired.
    """
    marked = (
        expected.select(*keys)
        .withColumn("_e", F.lit(1))
        .withColumn("_a", F.lit(0))
        .unionByName(
            actual.select(*keys).withColumn("_e", F.lit(0)).withColumn("_a", F.lit(1))
        )
    )
    counts = marked.groupBy(*keys).agg(
        F.sum("_e").alias("expected_rows"), F.sum("_a").alias("actual_rows")
    )
    problem = (
        F.when(F.col("actual_rows") == 0, "missing")
        .when(F.col("expected_rows") == 0, "unexpected")
        .when(F.col("actual_rows") > 1, "duplicate")
    )
    return counts.withColumn("problem", problem).where("problem IS NOT NULL")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows held by one side only, with multiplicity, in one aggregate."""
    columns = left.columns
    both = (
        left.select(*columns)
        .withColumn("_d", F.lit(1))
        .unionByName(right.select(*columns).withColumn("_d", F.lit(-1)))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("_d").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-insensitive equality token of a relation: row count and hash sum."""
    token = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(token).cast("string").alias("token")
    )
