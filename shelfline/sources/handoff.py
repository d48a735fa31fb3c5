"""Validated Parquet handoff, model-ready tables and forecast export files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, KEY, PANEL_COLUMNS, SERIES
from shelfline.functions.grids import fingerprint, multiset_difference
from shelfline.operators import quality as dq
from shelfline.operators.profile import month_label


class HandoffError(ValueError):
    """A published table differs from its receipt or contract."""


def sink_validated(raw: DataFrame, path: str) -> DataFrame:
    """Publish an accepted source: typed rows, audit, then the receipt.

    Rows are range-partitioned by month and series before the write, so a busy
    month or series is split over several files, a date scope prunes folders,
    and every file is sorted by series and day.  The receipt is written last;
    a folder without one is not a publication.
    """
    checks = dq.require_valid(raw)
    typed = dq.typed_panel(raw).withColumn("month", month_label())
    (
        typed.repartitionByRange("month", *SERIES)
        .sortWithinPartitions("month", *SERIES, "Date")
        .write.mode("errorifexists")
        .partitionBy("month")
        .parquet(f"{path}/panel")
    )
    checks.write.mode("errorifexists").parquet(f"{path}/audit")
    spark = raw.sparkSession
    stored = _open(spark, path)
    if not multiset_difference(typed.drop("month"), stored).isEmpty():
        raise HandoffError("stored rows differ from the validated rows")
    receipt(stored).coalesce(1).write.mode("errorifexists").json(f"{path}/receipt")
    return stored


def receipt(panel: DataFrame) -> DataFrame:
    """Row count, unique keys, date range and equality token: one row."""
    keys = (
        panel.groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(_row_hash()).alias("_h"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("unique_keys"),
            F.min("Date").alias("date_min"),
            F.max("Date").alias("date_max"),
            F.sum("_h").cast("string").alias("token"),
        )
    )
    return keys


def _row_hash():
    return F.xxhash64(*PANEL_COLUMNS).cast("decimal(38,0)")


def _open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/panel")


def scan_validated(spark: SparkSession, path: str) -> DataFrame:
    """Reopen a publication after checking its receipt, audit and rows again."""
    stored = _open(spark, path).select(*PANEL_COLUMNS)
    kept = spark.read.json(f"{path}/receipt").first()
    now = receipt(stored).first()
    if (kept["rows"], kept["unique_keys"], kept["token"]) != (
        now["rows"],
        now["unique_keys"],
        now["token"],
    ):
        raise HandoffError("publication differs from its receipt")
    again = dq.validation_checks(
        stored.select(*[F.col(c).cast("string").alias(c) for c in PANEL_COLUMNS])
    )
    if not multiset_difference(spark.read.parquet(f"{path}/audit"), again).isEmpty():
        raise HandoffError("stored audit differs from a new audit")
    return stored


def scan_projection(
    spark: SparkSession, path: str, columns: list[str], start: date, end: date
) -> DataFrame:
    """Column and date subset; both reach the Parquet scan."""
    rows = _open(spark, path)
    unknown = sorted(set(columns) - set(PANEL_COLUMNS))
    if unknown:
        raise HandoffError(f"unknown columns {unknown}")
    months = F.col("month").between(f"{start:%Y-%m}", f"{end:%Y-%m}")
    return rows.where(months & F.col("Date").between(F.lit(start), F.lit(end))).select(*columns)


def projection_defects(projection: DataFrame, start: date, end: date) -> DataFrame:
    """Nulls and a scope that reaches beyond the published dates."""
    return projection.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in projection.columns],
        F.coalesce((F.min("Date") > F.lit(start)) | (F.max("Date") < F.lit(end)), F.lit(True)).alias(
            "scope_exceeds_publication"
        ),
    )


# --- model-ready tables -----------------------------------------------------


def sink_model_ready(training: DataFrame, origins: DataFrame, path: str) -> None:
    """One table per kind for all folds and horizons, not a file per model.

    Range partitioning keeps the number of files proportional to the data.
    """
    (
        training.repartitionByRange("fold_id", "horizon", *SERIES)
        .write.mode("errorifexists")
        .partitionBy("fold_id", "horizon")
        .parquet(f"{path}/training")
    )
    (
        origins.repartitionByRange("fold_id", *SERIES)
        .write.mode("errorifexists")
        .partitionBy("fold_id")
        .parquet(f"{path}/origins")
    )


def scan_model_ready(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/training"), spark.read.parquet(f"{path}/origins")


def model_ready_defects(training: DataFrame, origins: DataFrame) -> DataFrame:
    """Null cells, duplicate keys and labels beyond the horizon boundary."""
    boundary = F.date_add("Date", F.col("horizon") - 1) > F.col("training_end")
    nulls = F.lit(False)
    for c in [*FEATURES, "target"]:
        nulls = nulls | F.col(c).isNull()
    per_key = training.groupBy("fold_id", "horizon", *SERIES, "Date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(nulls).alias("_nulls"),
        F.count_if(boundary).alias("_late"),
    )
    roster = origins.select("fold_id", *SERIES)
    orphan = (
        training.select("fold_id", *SERIES)
        .distinct()
        .join(roster, ["fold_id", *SERIES], "left_anti")
        .agg(F.count(F.lit(1)).alias("affected"))
        .select(F.lit("series_without_origin").alias("check"), "affected")
    )
    wide = per_key.agg(
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("null_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("_late"), F.lit(0)).alias("labels_after_boundary"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("training_rows"),
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("affected")) for c in wide.columns]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*").unionByName(orphan)


# --- forecast export --------------------------------------------------------

EXPORT_SCHEMA = (
    "SKU_ID STRING, Warehouse_ID STRING, forecast_origin DATE, horizon INT, "
    "target_start_date DATE, target_end_date DATE, prediction DOUBLE, model STRING, "
    "configuration_id STRING, run_id STRING, evaluation_stage STRING, evidence_role STRING, "
    "forecast_type STRING, unit STRING, producer_status STRING, forecast_status STRING, "
    "uncertainty STRUCT<status: STRING, reason: STRING>"
)


def sink_forecast_export(export: DataFrame, path: str) -> None:
    """Rows sorted by horizon and series, then a one-row envelope."""
    export.orderBy("horizon", *SERIES).write.mode("errorifexists").json(f"{path}/rows")
    envelope = export.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_distinct(*SERIES).alias("series_count"),
        F.min("forecast_origin").alias("forecast_origin"),
        F.max("run_id").alias("run_id"),
    )
    envelope.coalesce(1).write.mode("errorifexists").json(f"{path}/envelope")


def scan_forecast_export(spark: SparkSession, path: str) -> DataFrame:
    """Strict read: malformed documents fail, unknown fields are rejected."""
    present = {c for c in spark.read.json(f"{path}/rows", samplingRatio=1.0).columns}
    declared = {part.split()[0] for part in EXPORT_SCHEMA.split(", ") if ":" not in part.split()[0]}
    declared.discard("reason:")
    if present - declared:
        raise HandoffError(f"unknown export fields {sorted(present - declared)}")
    rows = spark.read.schema(EXPORT_SCHEMA).option("mode", "FAILFAST").json(f"{path}/rows")
    stated = spark.read.json(f"{path}/envelope").first()
    if stated["record_count"] != rows.count():
        raise HandoffError("export envelope and rows disagree")
    return rows


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    return fingerprint(df, columns)
