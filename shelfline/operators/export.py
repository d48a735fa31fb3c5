"""The forecast export: designated rows, population checks and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import HORIZONS, PRODUCERS, SERIES
from shelfline.functions.expr import any_of, explode_values, finite
from shelfline.functions.grids import grid_difference

EXPORT_KEY = [*SERIES, "horizon"]


def designated(producers=PRODUCERS) -> Column:
    """Rows of the producer designated for their horizon (no join needed)."""
    return any_of(
        (F.col("horizon") == h) & (F.col("model") == m) & (F.col("configuration_id") == c)
        for h, m, c in producers
    )


def forecast_type(horizon: Column | str = "horizon") -> Column:
    h = F.col(horizon) if isinstance(horizon, str) else horizon
    return F.when(h == 1, "next_day").otherwise("cumulative_window")


def build_export(rows: DataFrame, producers=PRODUCERS) -> DataFrame:
    """Export rows of the designated producers with constant status columns."""
    return rows.where(designated(producers)).select(
        *SERIES,
        "forecast_origin",
        "horizon",
        "target_start_date",
        "target_end_date",
        "prediction",
        "model",
        "configuration_id",
        "run_id",
        "evaluation_stage",
        "evidence_role",
        forecast_type().alias("forecast_type"),
        F.lit("units").alias("unit"),
        F.lit("designated_producer").alias("producer_status"),
        F.lit("available").alias("forecast_status"),
        F.struct(
            F.lit("unavailable").alias("status"), F.lit("no_agreed_method").alias("reason")
        ).alias("uncertainty"),
    )


def export_defects(export: DataFrame, roster: DataFrame, producers=PRODUCERS) -> DataFrame:
    """Missing, unexpected or duplicate (horizon, series) rows of an export."""
    planned = roster.select(*SERIES).distinct().select(
        *SERIES, explode_values([(h,) for h, _, _ in producers], ["horizon"]).alias("_h")
    ).select(*SERIES, "_h.horizon")
    return grid_difference(planned, export, EXPORT_KEY)


def unusable_quantities(export: DataFrame) -> DataFrame:
    """Export rows whose quantity is missing or not finite."""
    return export.where(~finite("prediction"))


def flat(export: DataFrame) -> DataFrame:
    """Export with the uncertainty struct flattened, in delivery order."""
    return export.select(
        *[c for c in export.columns if c != "uncertainty"],
        F.col("uncertainty.status").alias("uncertainty_status"),
        F.col("uncertainty.reason").alias("uncertainty_reason"),
    ).orderBy("horizon", *SERIES)


def gate_by_horizon(rows: DataFrame, always: list[str], gated: int = 28) -> DataFrame:
    """Null every column outside ``always`` on rows of the gated horizon."""
    return rows.select(
        *[
            F.col(c) if c in always else F.when(F.col("horizon") != gated, F.col(c)).alias(c)
            for c in rows.columns
        ]
    )


def aligned_series(export: DataFrame) -> DataFrame:
    """Series with exactly one row for each horizon at one origin."""
    return (
        export.groupBy(*SERIES, "forecast_origin")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("horizon").alias("horizons"),
        )
        .withColumn(
            "aligned", (F.col("row_count") == len(HORIZONS)) & (F.col("horizons") == len(HORIZONS))
        )
    )
