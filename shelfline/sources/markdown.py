"""Pipe-delimited result tables as a text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.expr import finite

# fixed values: evidence roles that mark a result row
ROLES = ("primary", "supportive", "simple_baseline")


def render_comparison(scores: DataFrame) -> DataFrame:
    """Score rows as nine-cell text lines (single column ``value``)."""
    def six(c: str):
        return F.format_string("%.6f", F.col(c))

    cells = [
        F.col("evidence_role"),
        F.col("model"),
        F.col("horizon").cast("string"),
        F.col("configuration_id"),
        six("wape"),
        six("mae"),
        six("rmse"),
        six("bias"),
        F.col("metric_status"),
    ]
    return scores.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
    )


def parse_comparison(lines: DataFrame) -> DataFrame:
    """Nine-cell result rows; other lines are ignored, numbers must parse."""
    inner = F.trim(F.regexp_replace(F.trim("value"), r"^\||\|$", ""))
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where(
        (F.size("c") == 9) & F.get("c", F.lit(0)).isin(*ROLES)
    )

    def num(i: int):
        return F.get("c", F.lit(i)).try_cast("double")

    return rows.select(
        F.get("c", F.lit(0)).alias("role"),
        F.get("c", F.lit(1)).alias("model"),
        F.get("c", F.lit(2)).try_cast("int").alias("horizon"),
        F.get("c", F.lit(3)).alias("configuration_id"),
        num(4).alias("WAPE"),
        num(5).alias("MAE"),
        num(6).alias("RMSE"),
        num(7).alias("Bias"),
        F.get("c", F.lit(8)).alias("status"),
    )


def comparison_defects(rows: DataFrame) -> DataFrame:
    """Duplicate (model, horizon, configuration), nonfinite or negative scores."""
    bad = ~(finite("WAPE") & finite("MAE") & finite("RMSE") & finite("Bias"))
    grouped = rows.groupBy("model", "horizon", "configuration_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad | (F.col("status") != "valid")).alias("bad"),
        F.count_if(F.coalesce(F.col("WAPE") < 0, F.lit(True))).alias("negative"),
    )
    return grouped.where("n > 1 OR bad > 0 OR negative > 0")


def scan_comparison(spark: SparkSession, path: str) -> DataFrame:
    return parse_comparison(spark.read.text(path))
