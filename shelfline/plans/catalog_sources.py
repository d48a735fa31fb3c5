"""Scan, sink and round-trip queries; files live below the shared folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.fixed import EXCLUSIONS, FOLD_METRIC_COLUMNS, MODEL_ORDER, PANEL_COLUMNS, SERIES
from shelfline.functions.grids import multiset_difference
from shelfline.operators import features as fe
from shelfline.operators import folds as fo
from shelfline.operators import metrics as me
from shelfline.operators import profile as pr
from shelfline.operators import quality as dq
from shelfline.plans.backtest_fixture import CANDIDATES_SQL, FOLDS, SCORE_SQL, SUMMARY_SQL, validation_rows
from shelfline.plans.catalog_features import _eligibility_sql as eligibility_sql
from shelfline.plans.catalog_features import prepared_sql
from shelfline.plans.catalog_inventory import EXPORT_COLUMNS
from shelfline.plans.catalog_profile import SUMMARY, r
from shelfline.plans.inventory_fixture import FINAL_SQL, final_export
from shelfline.plans.oracle_base import DEMAND, GAP, PANEL, whole, with_
from shelfline.plans.registry import query
from shelfline.session import scratch_path
from shelfline.sources import csv_source as cs
from shelfline.sources import handoff as ho
from shelfline.sources import identity as fi
from shelfline.sources import markdown as md
from shelfline.sources.panels import full_demand, full_panel, gap_panel, raw_panel

# publications and profiles cover the whole log; folds and origins the panel year
WHOLE_DEMAND, WHOLE_PANEL = whole(DEMAND), whole(PANEL)
START, END = date(1997, 3, 1), date(1997, 8, 31)
SCOPE = "Date BETWEEN DATE '1997-03-01' AND DATE '1997-08-31'"


@query(
    "scan_scoped_csv",
    "S1",
    with_(WHOLE_PANEL)
    + f"SELECT CAST(Date AS VARCHAR) AS Date, SKU_ID, Warehouse_ID, Supplier_ID, Region, CAST(Units_Sold AS VARCHAR) AS Units_Sold, CAST(Inventory_Level AS VARCHAR) AS Inventory_Level, CAST(Promotion_Flag AS VARCHAR) AS Promotion_Flag FROM panel WHERE {SCOPE}",
)
def scan_scoped_csv(spark, sf_dir):
    path = scratch_path(spark, "source-csv")
    shuffled = [PANEL_COLUMNS[-1], *PANEL_COLUMNS[:-1]]  # header order is free
    cs.write_csv(raw_panel(spark, sf_dir, whole=True).select(*shuffled), path)
    return cs.scan_scoped_csv(spark, path, START, END).select(
        "Date", *SERIES, "Supplier_ID", "Region", "Units_Sold", "Inventory_Level", "Promotion_Flag"
    )


def _published(spark, sf_dir):
    path = scratch_path(spark, "handoff")
    ho.sink_validated(raw_panel(spark, sf_dir, whole=True), path)
    return path


@query(
    "scan_projection",
    "S2",
    with_(WHOLE_PANEL) + f"SELECT SKU_ID, Warehouse_ID, Date, Units_Sold FROM panel WHERE {SCOPE}",
)
def scan_projection(spark, sf_dir):
    columns = [*SERIES, "Date", "Units_Sold"]
    return ho.scan_projection(spark, _published(spark, sf_dir), columns, START, END)


@query(
    "projection_defects",
    "S2 S3",
    with_(WHOLE_PANEL)
    + "SELECT CAST(0 AS BIGINT) AS null_SKU_ID, CAST(0 AS BIGINT) AS null_Units_Sold, max(Date) < DATE '2099-01-31' AS scope_exceeds_publication FROM panel",
)
def projection_defects(spark, sf_dir):
    end = date(2099, 1, 31)
    path = _published(spark, sf_dir)
    rows = ho.scan_projection(spark, path, ["SKU_ID", "Units_Sold", "Date"], START, end)
    return ho.projection_defects(rows, START, end).drop("null_Date")


@query(
    "scan_forecasting_projection",
    "S3 V16",
    with_(WHOLE_DEMAND)
    + "SELECT SKU_ID, Warehouse_ID, Date, Units_Sold FROM demand WHERE Date BETWEEN DATE '1997-01-01' AND DATE '1997-12-02'",
)
def scan_forecasting_projection(spark, sf_dir):
    columns = [*SERIES, "Date", "Units_Sold"]
    return ho.scan_projection(
        spark, _published(spark, sf_dir), columns, date(1997, 1, 1), date(1997, 12, 2)
    )


@query(
    "sink_validated",
    "S4 K5",
    with_(WHOLE_PANEL)
    + """SELECT count(*) AS rows, count(DISTINCT (SKU_ID, Warehouse_ID, Date)) AS unique_keys, min(Date) AS date_min, max(Date) AS date_max,
CAST(0 AS BIGINT) AS readback_differences FROM panel""",
)
def sink_validated(spark, sf_dir):
    stored = ho.scan_validated(spark, _published(spark, sf_dir))
    difference = multiset_difference(dq.typed_panel(raw_panel(spark, sf_dir, whole=True)), stored)
    n = difference.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ho.receipt(stored).drop("token").withColumn("readback_differences", n)


@query(
    "scan_validated",
    "S5 V1",
    with_(WHOLE_PANEL)
    + f"SELECT Date, SKU_ID, Warehouse_ID, Units_Sold, Inventory_Level, Reorder_Point, Order_Quantity, Promotion_Flag, round(Unit_Cost, 6) AS Unit_Cost FROM panel",
)
def scan_validated(spark, sf_dir):
    rows = ho.scan_validated(spark, _published(spark, sf_dir)).select(
        "Date",
        *SERIES,
        "Units_Sold",
        "Inventory_Level",
        "Reorder_Point",
        "Order_Quantity",
        "Promotion_Flag",
        "Unit_Cost",
    )
    return r(rows, "Unit_Cost")


@query(
    "output_receipt",
    "A36",
    with_(WHOLE_PANEL)
    + "SELECT count(*) AS rows, count(DISTINCT (SKU_ID, Warehouse_ID, Date)) AS unique_keys, min(Date) AS date_min, max(Date) AS date_max FROM panel",
)
def output_receipt(spark, sf_dir):
    return ho.receipt(full_panel(spark, sf_dir, whole=True)).drop("token")


def _model_ready(spark, sf_dir):
    demand = full_demand(spark, sf_dir)
    path = scratch_path(spark, "model-ready")
    ho.sink_model_ready(
        fo.training_rows(fe.features_and_targets(demand), FOLDS[:4]),
        fe.origin_features(demand, FOLDS[:4]),
        path,
    )
    return ho.scan_model_ready(spark, path)


@query(
    "sink_model_ready",
    "S6",
    with_(*prepared_sql(DEMAND, "demand"))
    + """SELECT fold_id, horizon, count(*) AS training_rows, CAST(sum(target) AS DOUBLE) AS target_total, round(sum(rolling_mean_28), 4) AS mean_total
FROM tagged WHERE ready AND inside AND target IS NOT NULL AND fold_id <= 4 GROUP BY 1, 2""",
)
def sink_model_ready(spark, sf_dir):
    training, _ = _model_ready(spark, sf_dir)
    return training.groupBy("fold_id", "horizon").agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.sum("target").alias("target_total"),
        F.round(F.sum("rolling_mean_28"), 4).alias("mean_total"),
    )


@query(
    "scan_model_ready",
    "S7",
    with_(*prepared_sql(DEMAND, "demand"))
    + """SELECT 'null_rows' AS "check", CAST(0 AS BIGINT) AS affected UNION ALL SELECT 'duplicate_keys', 0 UNION ALL SELECT 'labels_after_boundary', 0
UNION ALL SELECT 'training_rows', count(*) FROM tagged WHERE ready AND inside AND target IS NOT NULL AND fold_id <= 4 UNION ALL SELECT 'series_without_origin', 0""",
)
def scan_model_ready(spark, sf_dir):
    return ho.model_ready_defects(*_model_ready(spark, sf_dir))


METRIC_SCHEMA = T.StructType(
    [
        T.StructField(
            n,
            T.IntegerType()
            if n in ("horizon", "fold_id")
            else T.LongType()
            if n == "n_predictions"
            else T.DoubleType()
            if n in ("wape", "mae", "rmse", "bias", "wape_denominator")
            else T.DateType()
            if n.endswith(("_start", "_end", "_origin", "_date"))
            else T.StringType(),
        )
        for n in FOLD_METRIC_COLUMNS
    ]
)


@query(
    "evidence_csv",
    "S8 S9",
    with_(*CANDIDATES_SQL, SCORE_SQL)
    + f"""SELECT {', '.join(f'round({c}, 6) AS {c}' if c in ('wape', 'mae', 'rmse', 'bias', 'wape_denominator') else c for c in FOLD_METRIC_COLUMNS)} FROM scores WHERE fold_id <= 4""",
)
def evidence_csv(spark, sf_dir):
    keys = [c for c in FOLD_METRIC_COLUMNS[: FOLD_METRIC_COLUMNS.index("n_predictions")]]
    scores = me.score(validation_rows(spark, sf_dir), keys)
    path = scratch_path(spark, "fold-metrics")
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    cs.sink_evidence_csv(
        scores, FOLD_METRIC_COLUMNS, path, [rank, "horizon", "configuration_id", "fold_id"]
    )
    back = cs.scan_evidence_csv(spark, path, METRIC_SCHEMA)
    return r(back, "wape", "mae", "rmse", "bias", "wape_denominator")


def _evidence_table(spark, df, order):
    """A table through its evidence CSV: written in protocol order, read back by its own schema."""
    path = scratch_path(spark, "evidence")
    cs.sink_evidence_csv(df, df.columns, path, order)
    return cs.scan_evidence_csv(spark, path, df.schema)


@query(
    "evidence_csv_predictions",
    "S8 S9",
    with_(*CANDIDATES_SQL)
    + """SELECT run_id, evaluation_stage, evidence_role, model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID, forecast_origin, target_start_date,
target_end_date, round(prediction, 6) AS prediction, round(observed_target, 6) AS observed_target FROM frows WHERE fold_id <= 4""",
)
def evidence_csv_predictions(spark, sf_dir):
    names = ["run_id", "evaluation_stage", "evidence_role", "model", "horizon", "configuration_id", "fold_id", *SERIES, "forecast_origin", "target_start_date", "target_end_date", "prediction", "observed_target"]
    ranked = validation_rows(spark, sf_dir).select(*names)
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    back = _evidence_table(spark, ranked, [rank, "horizon", "configuration_id", "fold_id", *SERIES])
    return r(back, "prediction", "observed_target")


@query(
    "evidence_csv_summary",
    "S8 S9",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL)
    + """SELECT run_id, evaluation_stage, evidence_role, model, horizon, configuration_id, valid_fold_count, n_predictions,
round(mean_wape, 6) AS mean_wape, round(mean_mae, 6) AS mean_mae, round(mean_rmse, 6) AS mean_rmse, round(mean_bias, 6) AS mean_bias FROM summ""",
)
def evidence_csv_summary(spark, sf_dir):
    scores = me.score(validation_rows(spark, sf_dir), [*me.SUMMARY_KEYS, "fold_id"])
    means = [f"mean_{m}" for m in ("wape", "mae", "rmse", "bias")]
    names = ["run_id", "evaluation_stage", "evidence_role", "model", "horizon", "configuration_id", "valid_fold_count", "n_predictions", *means]
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    summary = me.configuration_summary(scores).select(*names)
    return r(_evidence_table(spark, summary, [rank, "horizon", "configuration_id"]), *means)


@query(
    "evidence_csv_exclusions",
    "S8 S9 A22",
    "WITH counts AS ("
    + eligibility_sql(GAP, "gap")
    + ") "
    + " UNION ALL ".join(
        f"SELECT fold_id, horizon, SKU_ID, Warehouse_ID, raw_row_count, training_row_count, '{name}' AS exclusion_reason, {name} AS reason_count FROM counts"
        for name in EXCLUSIONS
    ),
)
def evidence_csv_exclusions(spark, sf_dir):
    """Eligibility evidence with a row for each exclusion reason."""
    counts = fo.eligibility_counts(fe.features_and_targets(gap_panel(spark, sf_dir)), FOLDS)
    names = ["fold_id", "horizon", *SERIES, "raw_row_count", "training_row_count", "exclusion_reason", "reason_count"]
    return _evidence_table(spark, fo.exclusion_rows(counts).select(*names), ["horizon", "fold_id", *SERIES, "exclusion_reason"])


@query(
    "evidence_nonfinite_cells",
    "S9",
    with_(*CANDIDATES_SQL)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND NOT isfinite({c})) AS nonfinite FROM frows WHERE fold_id <= 4"
        for c in ("prediction", "observed_target")
    ),
)
def evidence_nonfinite_cells(spark, sf_dir):
    return cs.nonfinite_cells(
        validation_rows(spark, sf_dir).select("prediction", "observed_target")
    )


@query(
    "forecast_export_json",
    "S10 S11",
    with_(*FINAL_SQL)
    + f"""SELECT {EXPORT_COLUMNS}, CASE WHEN horizon = 1 THEN 'next_day' ELSE 'cumulative_window' END AS forecast_type, 'unavailable' AS uncertainty_status FROM fexport""",
)
def forecast_export_json(spark, sf_dir):
    path = scratch_path(spark, "export")
    ho.sink_forecast_export(final_export(spark, sf_dir), path)
    back = ho.scan_forecast_export(spark, path)
    keep = [c for c in back.columns if c not in ("unit", "producer_status", "forecast_status", "uncertainty")]
    return r(
        back.select(*keep, F.col("uncertainty.status").alias("uncertainty_status")), "prediction"
    )


@query(
    "sink_tables_csv",
    "S12",
    with_(WHOLE_PANEL) + f"SELECT SKU_ID, Warehouse_ID, {SUMMARY} FROM panel GROUP BY 1, 2",
)
def sink_tables_csv(spark, sf_dir):
    table = r(
        pr.summarize(full_panel(spark, sf_dir, whole=True), SERIES), "mean", "std", "zero_share", "promotion_share"
    )
    folder = scratch_path(spark, "profiles")
    cs.sink_tables_csv({"series": table}, folder)
    return (
        spark.read.schema(table.schema)
        .option("header", True)
        .option("nullValue", "")
        .csv(f"{folder}/series")
    )


@query(
    "parse_markdown_table",
    "S15",
    with_(*CANDIDATES_SQL, SCORE_SQL)
    + """SELECT evidence_role AS role, model, horizon, configuration_id, round(wape, 4) AS WAPE, round(mae, 4) AS MAE, round(rmse, 4) AS RMSE, round(bias, 4) AS Bias, metric_status AS status FROM scores WHERE fold_id = 4""",
)
def parse_markdown_table(spark, sf_dir):
    rows = validation_rows(spark, sf_dir).where("fold_id = 4")
    scores = me.score(rows, me.SUMMARY_KEYS)
    path = scratch_path(spark, "comparison")
    md.render_comparison(scores).write.mode("errorifexists").text(path)
    return r(md.scan_comparison(spark, path), "WAPE", "MAE", "RMSE", "Bias", digits=4)


@query(
    "content_identity_audit",
    "S14 U5",
    """WITH a AS (SELECT 'd' || doc_id AS file, sha256(text) AS actual FROM documents),
m AS (SELECT 'd' || doc_id AS file, CASE WHEN lang = 'de' THEN reverse(sha256(text)) ELSE sha256(text) END AS expected FROM documents
  UNION ALL SELECT 'b' || item_id, sha256(text) FROM benchmark)
SELECT COALESCE(a.file, m.file) AS file, CASE WHEN actual IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'UNLISTED' WHEN actual = expected THEN 'OK' ELSE 'MISMATCH' END AS status
FROM a FULL JOIN m ON a.file = m.file""",
)
def content_identity_audit(spark, sf_dir):
    """Whole texts hashed against a manifest with altered and absent entries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"),
        F.sha2("text", 256).alias("sha256"),
        "lang",
    )
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("file"),
        F.sha2("text", 256).alias("sha256"),
    )
    altered = F.when(F.col("lang") == "de", F.reverse("sha256")).otherwise(F.col("sha256"))
    manifest = docs.select("file", altered.alias("sha256")).unionByName(items)
    return fi.audit_files(docs, manifest).select("file", "status")


@query("file_identity_audit", "S14")
def file_identity_audit(spark, sf_dir):
    """Every table file of the folder against a manifest with known faults."""
    actual = fi.file_hashes(spark, sf_dir, "*.parquet")
    manifest = actual.where("file != 'region.parquet'").select(
        "file",
        F.when(F.col("file") == "orders.parquet", F.reverse("sha256"))
        .otherwise(F.col("sha256"))
        .alias("sha256"),
    ).unionByName(
        actual.where("file = 'part.parquet'").select(F.lit("gone.parquet").alias("file"), "sha256")
    )
    return fi.audit_files(actual, manifest).select("file", "status")


@query(
    "file_identity_counts",
    "S14",
)
def file_identity_counts(spark, sf_dir):
    actual = fi.file_hashes(spark, sf_dir, "*.parquet")
    return fi.audit_counts(fi.audit_files(actual, actual))


@query(
    "manifest_conflicts",
    "U5 S14",
    """WITH m AS (SELECT c_mktsegment || '-' || c_nationkey AS file, md5(CAST(floor(c_acctbal / 2500) AS BIGINT)::VARCHAR) AS h FROM customer)
SELECT file, count(*) AS entries, count(DISTINCT h) AS hashes FROM m GROUP BY 1 HAVING count(DISTINCT h) > 1""",
)
def manifest_conflicts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    band = F.floor(F.col("c_acctbal") / 2500).cast("long").cast("string")
    entries = c.select(
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("file"),
        F.md5(band).alias("sha256"),
    )
    return fi.manifest_conflicts(entries)


