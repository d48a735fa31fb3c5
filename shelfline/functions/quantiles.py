"""Exact linear-interpolated quantiles of unbounded groups.

``percentile`` keeps every distinct value of a group in one task.  That is fine
for demand units (few distinct integers) but not for per-series statistics,
whose distinct values grow with the number of series.  Here a bounded sketch
only *splits* the values into bins; the ranks that are asked for are then read
exactly from the one or two bins that hold them.  The sketch affects the work
done, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 64
DESCRIBE = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
MOMENTS = ["count", "mean", "std", "min", "max"]


def exact_percentiles(
    df: DataFrame,
    by: list[str],
    value: str,
    wanted: dict[str, float],
    with_moments: bool = False,
) -> DataFrame:
    """One row per group of ``by`` with a column per wanted probability.

    ``by`` must come from a short literal list (lags, grains, variable names):
    the per-group split points are broadcast, ``BINS`` doubles per group.  The
    input is shuffled once, as distinct values with counts; every later step
    reuses that exchange.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    fractions = [i / BINS for i in range(1, BINS)]
    cuts = counted.groupBy(*by).agg(
        F.percentile_approx("_v", fractions, 4 * BINS).alias("_cuts"),
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"),
    )
    binned = counted.join(F.broadcast(cuts), by).select(
        *by,
        "_v",
        "_c",
        "_mean",
        F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_bin"),
    )
    offset = F.col("_v") - F.col("_mean")
    per_bin = binned.groupBy(*by, "_bin").agg(
        F.sum("_c").alias("_n"),
        F.sum(offset * offset * F.col("_c")).alias("_ss"),
        F.max("_mean").alias("_mean"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    ordered = Window.partitionBy(*by).orderBy("_bin")  # at most BINS rows per group
    group = Window.partitionBy(*by)
    total = F.sum("_n").over(group)
    spans = per_bin.select(
        *by,
        "_bin",
        (F.sum("_n").over(ordered) - F.col("_n")).alias("_start"),
        F.sum("_n").over(ordered).alias("_stop"),
        total.alias("count"),
        F.max("_mean").over(group).alias("mean"),
        F.sqrt(F.sum("_ss").over(group) / F.nullif(total - 1, F.lit(0))).alias("std"),
        F.min("_min").over(group).alias("min"),
        F.max("_max").over(group).alias("max"),
    )
    last = F.col("count") - 1
    hit = F.lit(False)
    for p in wanted.values():
        for rank in (F.floor(last * p), F.ceil(last * p)):
            hit = hit | ((rank >= F.col("_start")) & (rank < F.col("_stop")))
    # at most two bins per group and probability survive
    chosen = F.broadcast(spans.where(hit))
    within = Window.partitionBy(*by, "_bin").orderBy("_v")
    ranked = (
        binned.select(*by, "_bin", "_v", "_c")
        .join(chosen, [*by, "_bin"])
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(within))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )

    def value_at(rank):
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))

    columns = []
    for name, p in wanted.items():
        position = last * p
        low, high = value_at(F.floor(position)), value_at(F.ceil(position))
        weight = F.max(position - F.floor(position))
        columns.append((low + (high - low) * weight).alias(name))
    moments = [F.max(m).alias(m) for m in MOMENTS] if with_moments else []
    return ranked.groupBy(*by).agg(*moments, *columns)


def column_medians(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(``name``, median) of each listed column over the whole table."""
    entries = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("_x")) for c in columns]
    )
    long = df.select(F.explode(entries).alias("e")).select("e.*")
    return exact_percentiles(long, [name], "_x", {"median": 0.5})


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of ``value`` per group.

    Groups without any value have no row.
    """
    return exact_percentiles(df, by, value, DESCRIBE, with_moments=True).select(
        *by, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )
