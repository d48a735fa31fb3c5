"""Inventory inputs derived from the panel: defective cells and final forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.fixed import PRODUCERS, SERIES
from shelfline.operators import export as ex
from shelfline.plans.backtest_fixture import CANDIDATES_SQL, sealed_rows
from shelfline.sources.panels import (
    day_no,
    published_demand,
    published_panel,
    rank_tables,
    with_inventory,
)
from datetime import date

ORIGIN = date(1997, 12, 2)


def defective_records(spark, sf_dir):
    """One forecast/inventory record per row of the whole panel, cells broken by rule."""
    skus, whs = rank_tables(spark, sf_dir)
    p = (
        with_inventory(published_demand(spark, sf_dir, whole=True), skus, whs)
        .join(skus, "SKU_ID")
        .join(whs, "Warehouse_ID")
        .withColumn("k", day_no() * 31 + F.col("_sn") * 7 + F.col("_wn"))
    )
    k, d = F.col("k"), F.col("Date")
    h = F.element_at(F.array(*[F.lit(x) for x in (1, 7, 14, 28, 3)]), (k % 5 + 1).cast("int"))

    def text(c):
        return F.col(c).cast("string")

    return p.select(
        *SERIES,
        F.when(k % 37 == 0, F.lit("bad")).otherwise(d.cast("string")).alias("forecast_origin"),
        F.when(k % 43 == 0, F.lit(None))
        .when(k % 41 == 0, F.date_add(d, 1).cast("string"))
        .otherwise(d.cast("string"))
        .alias("Date"),
        h.cast("string").alias("horizon"),
        F.date_add(d, 1).cast("string").alias("target_start_date"),
        F.date_add(d, F.when(k % 47 == 0, h + 1).otherwise(h)).cast("string").alias("target_end_date"),
        F.when(k % 53 == 0, "abc")
        .when(k % 59 == 0, "-2.5")
        .when(k % 61 == 0, "NaN")
        .when(k % 67 == 0, "Infinity")
        .otherwise((F.col("Units_Sold") * 5 + k % 4).cast("string"))
        .alias("prediction"),
        F.when(k % 71 == 0, F.lit(None))
        .when(k % 73 == 0, F.lit("2.5"))
        .otherwise((F.col("Units_Sold") * 5).cast("string"))
        .alias("observed_target"),
        F.when(k % 79 == 0, "missing").otherwise("available").alias("prediction_status"),
        F.when(k % 83 != 0, "complete").alias("target_status"),
        F.when(k % 89 == 0, "no").otherwise("eligible").alias("eligibility_status"),
        F.when(k % 97 == 0, "-1").otherwise(text("Inventory_Level")).alias("Inventory_Level"),
        F.when(k % 101 == 0, "1.5").otherwise(text("Reorder_Point")).alias("Reorder_Point"),
        F.when(k % 11 == 1, False).when(k % 11 != 0, True).alias("origin_snapshot_available"),
        F.when(k % 2 == 0, "ledger_closed").alias("origin_snapshot_unavailable_reason"),
        "Supplier_Lead_Time_Days",
        "Order_Quantity",
        F.when(k % 7 == 1, False).when(k % 7 != 0, True).alias("supplier_lead_time_available_at_origin"),
        F.when(k % 13 == 1, False).when(k % 13 != 0, True).alias("order_quantity_available_at_origin"),
        F.lit("r1").alias("run_id"),
        F.lit("validation").alias("evaluation_stage"),
        F.lit("primary").alias("evidence_role"),
        F.lit("xgboost").alias("model"),
        F.lit("GBM001").alias("configuration_id"),
        (d.cast("string")).alias("record_day"),
    )


RECORDS_SQL = """
recs AS (SELECT SKU_ID, Warehouse_ID, k, Date AS d,
  CASE WHEN k % 37 = 0 THEN NULL ELSE Date END AS origin,
  CASE WHEN k % 43 = 0 THEN NULL WHEN k % 41 = 0 THEN Date + 1 ELSE Date END AS rec,
  h3, CASE WHEN h3 = 3 THEN NULL ELSE h3 END AS h, Date + 1 AS ts,
  Date + CAST(CASE WHEN k % 47 = 0 THEN h3 + 1 ELSE h3 END AS INTEGER) AS te,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN -2.5 WHEN k % 61 = 0 OR k % 67 = 0 THEN NULL
    ELSE CAST(Units_Sold * 5 + k % 4 AS DOUBLE) END AS pred,
  CASE WHEN k % 71 = 0 OR k % 73 = 0 THEN NULL ELSE CAST(Units_Sold * 5 AS DOUBLE) END AS obs,
  CASE WHEN k % 97 = 0 THEN NULL ELSE CAST(Inventory_Level AS DOUBLE) END AS lvl,
  CASE WHEN k % 101 = 0 THEN NULL ELSE CAST(Reorder_Point AS DOUBLE) END AS rop,
  CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS marker,
  CASE WHEN k % 2 = 0 THEN 'ledger_closed' END AS given,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS lead_marker,
  CASE k % 13 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS order_marker,
  Supplier_Lead_Time_Days AS lead
  FROM (SELECT *, n * 31 + sn * 7 + wn AS k,
    CASE (n * 31 + sn * 7 + wn) % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 14 WHEN 3 THEN 28 ELSE 3 END AS h3 FROM panel) AS p),
snap AS (SELECT *, CASE WHEN marker IS NULL THEN 'unknown' WHEN marker AND origin IS NOT NULL AND rec IS NOT NULL AND rec = origin THEN 'available' ELSE 'unavailable' END AS snap_status,
  CASE WHEN marker IS NULL THEN 'origin_snapshot_availability_not_established'
    WHEN NOT marker THEN COALESCE(given, 'origin_snapshot_not_available_at_forecast_origin')
    WHEN origin IS NULL OR rec IS NULL THEN 'invalid_origin_or_inventory_record_date'
    WHEN rec <> origin THEN 'inventory_record_date_does_not_match_forecast_origin' ELSE '' END AS snap_reason FROM recs),
ladder AS (SELECT *,
  CASE WHEN h = 28 THEN 'not_approved_for_downstream_use' WHEN h IS NULL THEN 'unavailable' ELSE 'approved_method' END AS gate,
  CASE WHEN h = 28 THEN '28_day_downstream_use_requires_separate_approval' WHEN h IS NULL THEN 'unsupported_or_invalid_forecast_horizon' ELSE '' END AS gate_reason,
  CASE WHEN h IS NULL THEN 'unsupported_or_invalid_forecast_horizon' END AS i1,
  CASE WHEN origin IS NULL THEN 'forecast_origin_missing_or_invalid' WHEN h IS NOT NULL AND (ts <> origin + 1 OR te <> origin + CAST(h AS INTEGER)) THEN
    'forecast_target_interval_does_not_match_origin_and_horizon' END AS i2,
  CASE WHEN pred IS NULL THEN 'forecast_missing_or_nonfinite' WHEN pred < 0 THEN 'negative_forecast_handling_not_approved' END AS f1,
  CASE WHEN k % 79 = 0 THEN 'forecast_prediction_status_not_available' END AS f2,
  CASE WHEN k % 89 = 0 THEN 'forecast_eligibility_status_not_eligible' END AS f3,
  CASE WHEN obs IS NULL THEN 'realised_horizon_demand_unavailable' END AS q1,
  CASE WHEN k % 83 = 0 THEN 'retrospective_target_status_not_complete' END AS q2 FROM snap),
prep AS (SELECT *, concat_ws(';', i1, i2, f1, f2, f3) AS f_reason, concat_ws(';', i1, i2, q1, q2) AS r_reason,
  snap_status = 'available' AND lvl IS NOT NULL AND rop IS NOT NULL AS inv_ok,
  CASE WHEN lead_marker IS NULL THEN 'unknown' WHEN lead_marker AND snap_status = 'available' THEN 'available_as_context_only' ELSE 'unavailable' END AS lead_status,
  CASE WHEN order_marker IS NULL THEN 'unknown' WHEN order_marker AND snap_status = 'available' THEN 'available_as_context_only' ELSE 'unavailable' END AS order_status,
  CASE WHEN lead_marker IS NULL THEN 'Supplier_Lead_Time_Days_availability_at_origin_not_established' WHEN NOT lead_marker THEN 'Supplier_Lead_Time_Days_not_available_at_origin'
    WHEN snap_status <> 'available' THEN 'Supplier_Lead_Time_Days_origin_record_not_available' END AS c1,
  CASE WHEN order_marker IS NULL THEN 'Order_Quantity_availability_at_origin_not_established' WHEN NOT order_marker THEN 'Order_Quantity_not_available_at_origin'
    WHEN snap_status <> 'available' THEN 'Order_Quantity_origin_record_not_available' END AS c2,
  CASE WHEN snap_status <> 'available' THEN snap_reason END AS s1, CASE WHEN lvl IS NULL THEN 'inventory_level_missing_or_invalid' END AS s2,
  CASE WHEN rop IS NULL THEN 'reorder_point_missing_or_invalid' END AS s3 FROM ladder),
prep2 AS (SELECT *, list_filter([s1, s2, s3, i1, i2, f1, f2, f3, q1, q2, c1, c2], lambda t: t IS NOT NULL) AS all_reasons FROM prep)"""


def cases_sql(scenario: bool) -> str:
    usable = (
        "COALESCE(origin = rec AND lvl IS NOT NULL AND rop IS NOT NULL, false)" if scenario else "inv_ok"
    )
    prefix = "scenario_" if scenario else ""
    known = "not_needed_scenario_origin_state" if scenario else "not_needed_origin_state_known"
    below = "scenario_at_or_below_threshold" if scenario else "origin_known_at_or_below_threshold"
    first = "['scenario_origin_snapshot_missing_or_invalid']" if scenario else "[]"
    return f"""
ready AS (SELECT *, {usable} AS usable, CASE WHEN {usable} THEN lvl - rop END AS buffer FROM prep2),
ready2 AS (SELECT *, COALESCE(buffer > 0 AND h IN (1, 7, 14) AND f_reason = '', false) AS fr,
  COALESCE(buffer > 0 AND h IN (1, 7, 14) AND r_reason = '', false) AS ar FROM ready),
cases AS (SELECT *,
  CASE WHEN buffer <= 0 THEN '{prefix}already_at_or_below_threshold' WHEN buffer > 0 THEN '{prefix}initially_above_threshold' ELSE 'unavailable' END AS origin_state,
  CASE WHEN buffer <= 0 THEN '{known}' WHEN fr AND pred >= buffer THEN 'forecast_crossing' WHEN fr THEN 'no_forecast_crossing' ELSE 'unavailable' END AS forecast_state,
  CASE WHEN buffer <= 0 THEN 'not_in_primary_comparison' WHEN ar AND obs >= buffer THEN 'realised_crossing' WHEN ar THEN 'no_realised_crossing' ELSE 'unavailable' END AS retro_state,
  CASE WHEN fr THEN buffer - pred END AS p_margin, CASE WHEN ar THEN buffer - obs END AS r_margin,
  CASE WHEN buffer <= 0 THEN '{below}' WHEN fr AND ar THEN 'evaluable_paired_case' ELSE 'unavailable' END AS cmp,
  CASE WHEN fr AND ar THEN CASE WHEN pred >= buffer AND obs >= buffer THEN 'TP' WHEN pred < buffer AND obs < buffer THEN 'TN' WHEN pred < buffer THEN 'FN' ELSE 'FP' END END AS cell,
  CASE WHEN NOT usable THEN list_concat({first}, all_reasons, [snap_reason]) WHEN buffer <= 0 THEN []
    ELSE list_concat(
      CASE WHEN fr THEN [] ELSE string_split(CASE WHEN h = 28 THEN gate_reason WHEN f_reason <> '' THEN f_reason ELSE 'forecast_exposure_not_assessed' END, ';') END,
      CASE WHEN ar THEN [] ELSE string_split(CASE WHEN h = 28 THEN gate_reason WHEN r_reason <> '' THEN r_reason ELSE 'retrospective_exposure_not_assessed' END, ';') END) END AS ev
  FROM ready2)"""


def ordered(list_sql: str) -> str:
    """Distinct non-empty items of a list in first-seen order, joined."""
    return (
        f"array_to_string(list_filter(list_filter({list_sql}, lambda t: t <> ''), "
        f"lambda t, i: list_position(list_filter({list_sql}, lambda t: t <> ''), t) = i), ';')"
    )


# --- final forecasts x origin inventory x later sales -----------------------


def final_export(spark, sf_dir):
    """Designated final forecasts, made before any outcome is read; a rule makes some negative."""
    rows = sealed_rows(spark, sf_dir, PRODUCERS)
    rule = (F.length("SKU_ID") + F.length("Warehouse_ID") + F.col("horizon")) % 7 == 0
    return ex.build_export(rows).withColumn(
        "prediction", F.when(rule, -F.col("prediction") - 1).otherwise(F.col("prediction"))
    )


def origin_inventory(spark, sf_dir):
    """Origin-day snapshots; some series have none."""
    return published_panel(spark, sf_dir).where(
        (F.col("Date") == F.lit(ORIGIN))
        & ((F.length("SKU_ID") * 3 + F.length("Warehouse_ID")) % 9 != 0)
    )


def later_sales(spark, sf_dir):
    """Sales of the fourteen days after the origin; one day of one SKU is lost."""
    return published_demand(spark, sf_dir).where(
        (F.col("Date") > F.lit(ORIGIN))
        & (F.col("Date") <= F.date_add(F.lit(ORIGIN), 14))
        & ~((F.col("SKU_ID") == "LARGE") & (F.col("Date") == F.lit(date(1997, 12, 10))))
    )


FINAL_SQL = [
    *CANDIDATES_SQL,
    """fexport AS (SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, target_start_date, target_end_date,
  CASE WHEN (length(SKU_ID) + length(Warehouse_ID) + horizon) % 7 = 0 THEN -prediction - 1 ELSE prediction END AS prediction,
  model, configuration_id, run_id, evaluation_stage, evidence_role FROM frows WHERE fold_id = 5 AND
  (horizon, model, configuration_id) IN ((1, 'lightgbm', 'GBM018'), (7, 'lightgbm', 'GBM011'), (14, 'xgboost', 'GBM022'), (28, 'xgboost', 'GBM003')))""",
    """inv AS (SELECT * FROM panel WHERE Date = DATE '1997-12-02' AND (length(SKU_ID) * 3 + length(Warehouse_ID)) % 9 <> 0)""",
    """later AS (SELECT * FROM demand WHERE Date > DATE '1997-12-02' AND Date <= DATE '1997-12-16' AND NOT (SKU_ID = 'LARGE' AND Date = DATE '1997-12-10'))""",
    """retro AS (SELECT e.SKU_ID, e.Warehouse_ID, e.forecast_origin, e.horizon, count(l.Date) AS present, sum(l.Units_Sold) AS total
  FROM fexport e LEFT JOIN later l ON l.SKU_ID = e.SKU_ID AND l.Warehouse_ID = e.Warehouse_ID AND l.Date BETWEEN e.target_start_date AND e.target_end_date
  WHERE e.horizon <> 28 GROUP BY 1, 2, 3, 4)""",
]


def joined_sql(policy: str) -> str:
    marker = {"source-confirmed": "true"}.get(policy, "CAST(NULL AS BOOLEAN)")
    return f"""
joined AS (SELECT e.*, i.Date AS snap_date, i.Inventory_Level, i.Reorder_Point, CASE WHEN i.SKU_ID IS NULL THEN false ELSE {marker} END AS marker,
  CASE WHEN i.SKU_ID IS NULL THEN 'origin_inventory_record_missing' END AS given, r.present,
  CASE WHEN r.present = e.horizon THEN CAST(r.total AS BIGINT) END AS observed_target
  FROM fexport e LEFT JOIN inv i ON i.SKU_ID = e.SKU_ID AND i.Warehouse_ID = e.Warehouse_ID AND i.Date = e.forecast_origin
  LEFT JOIN retro r ON r.SKU_ID = e.SKU_ID AND r.Warehouse_ID = e.Warehouse_ID AND r.horizon = e.horizon)"""


def final_cases_sql(policy: str) -> str:
    scenario = policy == "constructed-origin"
    usable = "i_ok" if scenario else ("marker AND i_ok" if policy == "source-confirmed" else "false")
    p = "scenario_" if scenario else ""
    known = "not_needed_scenario_origin_state" if scenario else "not_needed_origin_state_known"
    below = "scenario_at_or_below_threshold" if scenario else "origin_known_at_or_below_threshold"
    return joined_sql(policy) + f""",
st AS (SELECT *, snap_date IS NOT NULL AS i_ok,
  CASE WHEN marker IS NULL THEN 'unknown' WHEN marker THEN 'available' ELSE 'unavailable' END AS snap_status,
  CASE WHEN marker IS NULL THEN 'origin_snapshot_availability_not_established' WHEN marker THEN '' ELSE given END AS snap_reason,
  CASE WHEN prediction < 0 THEN 'negative_forecast_handling_not_approved;forecast_eligibility_status_not_eligible' ELSE '' END AS f_reason,
  CASE WHEN observed_target IS NULL THEN 'realised_horizon_demand_unavailable;retrospective_target_status_not_complete' ELSE '' END AS r_reason FROM joined),
st2 AS (SELECT *, COALESCE({usable}, false) AND horizon <> 28 AS usable, CASE WHEN COALESCE({usable}, false) AND horizon <> 28 THEN CAST(Inventory_Level - Reorder_Point AS DOUBLE) END AS buffer FROM st),
fcases AS (SELECT *,
  COALESCE(buffer > 0 AND f_reason = '', false) AS fr, COALESCE(buffer > 0 AND r_reason = '', false) AS ar,
  CASE WHEN buffer <= 0 THEN '{p}already_at_or_below_threshold' WHEN buffer > 0 THEN '{p}initially_above_threshold' ELSE 'unavailable' END AS origin_state,
  CASE WHEN buffer <= 0 THEN '{known}' WHEN buffer > 0 AND f_reason = '' THEN CASE WHEN prediction >= buffer THEN 'forecast_crossing' ELSE 'no_forecast_crossing' END ELSE 'unavailable' END AS forecast_state,
  CASE WHEN buffer > 0 AND f_reason = '' THEN buffer - prediction END AS p_margin,
  CASE WHEN buffer > 0 AND r_reason = '' THEN buffer - observed_target END AS r_margin,
  CASE WHEN buffer <= 0 THEN 'not_in_primary_comparison' WHEN buffer > 0 AND r_reason = '' THEN CASE WHEN observed_target >= buffer THEN 'realised_crossing' ELSE 'no_realised_crossing' END ELSE 'unavailable' END AS retro_state,
  CASE WHEN buffer <= 0 THEN '{below}' WHEN buffer > 0 AND f_reason = '' AND r_reason = '' THEN 'evaluable_paired_case' ELSE 'unavailable' END AS cmp,
  CASE WHEN buffer > 0 AND f_reason = '' AND r_reason = '' THEN
    CASE WHEN prediction >= buffer AND observed_target >= buffer THEN 'TP' WHEN prediction < buffer AND observed_target < buffer THEN 'TN' WHEN prediction < buffer THEN 'FN' ELSE 'FP' END END AS cell
  FROM st2)"""


SUMMARY_BODY = """count(*) FILTER (cell IS NOT NULL) AS N, count(*) FILTER (cell = 'TP') AS TP, count(*) FILTER (cell = 'TN') AS TN, count(*) FILTER (cell = 'FP') AS FP,
count(*) FILTER (cell = 'FN') AS FN, count(*) FILTER (cmp = 'origin_known_at_or_below_threshold') AS origin_known_at_or_below_count,
count(*) FILTER (cmp = 'scenario_at_or_below_threshold') AS scenario_at_or_below_count, count(*) FILTER (origin_state LIKE '%initially_above_threshold') AS initially_above_threshold_count,
count(*) FILTER (cmp = 'unavailable') AS unavailable_case_count,
count(*) FILTER (origin_state LIKE '%initially_above_threshold' AND (f_reason <> '' OR {out})) AS forecast_unavailable_or_gated_count,
count(*) FILTER (origin_state LIKE '%initially_above_threshold' AND (r_reason <> '' OR {out})) AS retrospective_unavailable_or_gated_count"""
RATES_SQL = {
    "event_prevalence": ("(TP + FN)", "N"),
    "missed_crossing_rate": ("FN", "(TP + FN)"),
    "false_alert_rate": ("FP", "(FP + TN)"),
    "agreement": ("(TP + TN)", "N"),
    "precision": ("TP", "(TP + FP)"),
    "recall": ("TP", "(TP + FN)"),
}


def rate_value(name: str) -> str:
    if name == "balanced_accuracy":
        return "0.5 * (TP / CAST(nullif(TP + FN, 0) AS DOUBLE) + TN / CAST(nullif(TN + FP, 0) AS DOUBLE))"
    top, bottom = RATES_SQL[name]
    return f"{top} / CAST(nullif({bottom}, 0) AS DOUBLE)"


def rate_columns() -> str:
    out = []
    for name in [*RATES_SQL, "balanced_accuracy"]:
        missing = (
            "unavailable_undefined_class_rate"
            if name == "balanced_accuracy"
            else "unavailable_zero_denominator"
        )
        value = rate_value(name)
        out.append(f"round({value}, 6) AS {name}")
        out.append(f"CASE WHEN {value} IS NULL THEN '{missing}' ELSE 'available' END AS {name}_status")
    return ", ".join(out)


