"""Export, inventory exposure and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.fixed import RATES, SERIES
from shelfline.operators import export as ex
from shelfline.operators import inventory as iv
from shelfline.plans.backtest_fixture import CANDIDATES_SQL, sealed_rows
from shelfline.plans.catalog_profile import r
from shelfline.plans.inventory_fixture import (
    FINAL_SQL,
    RECORDS_SQL,
    SUMMARY_BODY,
    cases_sql,
    defective_records,
    final_cases_sql,
    final_export,
    joined_sql,
    later_sales,
    ordered,
    origin_inventory,
    rate_columns,
    rate_value,
)
from shelfline.plans.oracle_base import PANEL, whole, with_
from shelfline.plans.registry import query
from shelfline.sources.panels import full_demand

EXPORT_COLUMNS = "SKU_ID, Warehouse_ID, forecast_origin, horizon, target_start_date, target_end_date, round(prediction, 6) AS prediction, model, configuration_id, run_id, evaluation_stage, evidence_role"


@query(
    "export_build",
    "M17 P7",
    with_(*CANDIDATES_SQL)
    + f"""SELECT {EXPORT_COLUMNS}, CASE WHEN horizon = 1 THEN 'next_day' ELSE 'cumulative_window' END AS forecast_type, 'units' AS unit,
'designated_producer' AS producer_status, 'available' AS forecast_status, 'unavailable' AS uncertainty_status, 'no_agreed_method' AS uncertainty_reason
FROM frows WHERE fold_id = 5 AND (horizon, model, configuration_id) IN ((1, 'lightgbm', 'GBM018'), (7, 'lightgbm', 'GBM011'), (14, 'xgboost', 'GBM022'), (28, 'xgboost', 'GBM003'))""",
)
def export_build(spark, sf_dir):
    return r(ex.flat(ex.build_export(sealed_rows(spark, sf_dir))), "prediction")


@query(
    "designated_filter",
    "P7",
    with_(*CANDIDATES_SQL)
    + """SELECT model, horizon, configuration_id, count(*) AS n_rows FROM frows WHERE fold_id = 5 AND
(horizon, model, configuration_id) IN ((1, 'lightgbm', 'GBM018'), (7, 'lightgbm', 'GBM011'), (14, 'xgboost', 'GBM022'), (28, 'xgboost', 'GBM003')) GROUP BY 1, 2, 3""",
)
def designated_filter(spark, sf_dir):
    return (
        sealed_rows(spark, sf_dir)
        .where(ex.designated())
        .groupBy("model", "horizon", "configuration_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "export_population_check",
    "J9 M17",
    with_(*FINAL_SQL)
    + """, kept AS (SELECT * FROM fexport WHERE NOT (SKU_ID = 'PROMO' AND horizon = 14))
SELECT f.SKU_ID, f.Warehouse_ID, f.horizon, 1 AS expected_rows, 0 AS actual_rows, 'missing' AS problem FROM fexport f
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.SKU_ID = f.SKU_ID AND k.Warehouse_ID = f.Warehouse_ID AND k.horizon = f.horizon)""",
)
def export_population_check(spark, sf_dir):
    export = final_export(spark, sf_dir)
    kept = export.where(~((F.col("SKU_ID") == "PROMO") & (F.col("horizon") == 14)))
    return ex.export_defects(kept, full_demand(spark, sf_dir))


@query(
    "aligned_horizon_cases",
    "J7",
    with_(*FINAL_SQL)
    + """, kept AS (SELECT * FROM fexport WHERE NOT (Warehouse_ID = 'ASIA' AND horizon = 7))
SELECT SKU_ID, Warehouse_ID, forecast_origin, count(*) AS row_count, count(DISTINCT horizon) AS horizons, count(*) = 4 AND count(DISTINCT horizon) = 4 AS aligned FROM kept GROUP BY 1, 2, 3""",
)
def aligned_horizon_cases(spark, sf_dir):
    export = final_export(spark, sf_dir)
    return ex.aligned_series(
        export.where(~((F.col("Warehouse_ID") == "ASIA") & (F.col("horizon") == 7)))
    )


PREP = [whole(PANEL), RECORDS_SQL]
ID_SQL = "SKU_ID, Warehouse_ID, CAST(d AS VARCHAR) AS record_day"
ID = [*SERIES, "record_day"]


def _prepared(spark, sf_dir):
    return iv.prepare(defective_records(spark, sf_dir))


@query(
    "inv_parse",
    "I1",
    with_(*PREP)
    + f"SELECT {ID_SQL}, origin, rec AS record_date, CAST(h AS INTEGER) AS horizon_days, pred AS demand, lvl AS level_value, rop AS reorder_value, obs AS observed_value FROM recs",
)
def inv_parse(spark, sf_dir):
    p = iv.parse_cells(defective_records(spark, sf_dir))
    return p.select(
        *ID,
        F.col("_origin").alias("origin"),
        F.col("_record").alias("record_date"),
        F.col("_horizon").alias("horizon_days"),
        F.col("_demand").alias("demand"),
        F.col("_level").alias("level_value"),
        F.col("_reorder").alias("reorder_value"),
        F.col("_observed").alias("observed_value"),
    )


@query(
    "inv_snapshot_status",
    "I2",
    with_(*PREP)
    + f"SELECT {ID_SQL}, snap_status AS origin_snapshot_status, snap_reason AS origin_snapshot_reason, inv_ok AS inventory_state_available FROM prep",
)
def inv_snapshot_status(spark, sf_dir):
    return _prepared(spark, sf_dir).select(
        *ID, "origin_snapshot_status", "origin_snapshot_reason", "inventory_state_available"
    )


@query(
    "inv_downstream_gate",
    "I3",
    with_(*PREP) + f"SELECT {ID_SQL}, gate AS downstream_use_status, gate_reason AS downstream_use_reason FROM prep",
)
def inv_downstream_gate(spark, sf_dir):
    return _prepared(spark, sf_dir).select(*ID, "downstream_use_status", "downstream_use_reason")


@query(
    "inv_forecast_status",
    "I4 I5",
    with_(*PREP)
    + f"SELECT {ID_SQL}, CASE WHEN f_reason = '' THEN 'available' ELSE 'unavailable' END AS forecast_input_status, f_reason AS forecast_input_reason FROM prep",
)
def inv_forecast_status(spark, sf_dir):
    return _prepared(spark, sf_dir).select(*ID, "forecast_input_status", "forecast_input_reason")


@query(
    "inv_retro_status",
    "I6 I4",
    with_(*PREP)
    + f"SELECT {ID_SQL}, CASE WHEN r_reason = '' THEN 'available' ELSE 'unavailable' END AS retrospective_input_status, r_reason AS retrospective_input_reason FROM prep",
)
def inv_retro_status(spark, sf_dir):
    return _prepared(spark, sf_dir).select(
        *ID, "retrospective_input_status", "retrospective_input_reason"
    )


@query(
    "inv_interval_check",
    "I4",
    with_(*PREP) + f"SELECT {ID_SQL}, concat_ws(';', i1, i2) AS interval_reasons FROM ladder",
)
def inv_interval_check(spark, sf_dir):
    cells = iv.parse_cells(defective_records(spark, sf_dir))
    return cells.select(
        *ID,
        F.array_join(F.array_compact(F.array(*iv.interval_reasons())), ";").alias("interval_reasons"),
    )


@query(
    "inv_context_status",
    "I7",
    with_(*PREP)
    + f"SELECT {ID_SQL}, lead_status AS lead_time_context_status, order_status AS order_quantity_context_status FROM prep",
)
def inv_context_status(spark, sf_dir):
    return _prepared(spark, sf_dir).select(
        *ID, "lead_time_context_status", "order_quantity_context_status"
    )


@query(
    "inv_lead_time_relation",
    "I8",
    with_(*PREP)
    + f"""SELECT {ID_SQL}, CASE WHEN lead_status = 'available_as_context_only' AND h IS NOT NULL THEN CASE WHEN h < lead THEN 'horizon_shorter_than_lead_time'
WHEN h = lead THEN 'horizon_equal_to_lead_time' ELSE 'horizon_longer_than_lead_time' END END AS lead_time_horizon_relation FROM prep""",
)
def inv_lead_time_relation(spark, sf_dir):
    return _prepared(spark, sf_dir).select(*ID, "lead_time_horizon_relation")


@query(
    "inv_prepare",
    "I9",
    with_(*PREP)
    + f"""SELECT {ID_SQL}, 'group_approved' AS methodology_status, snap_status AS origin_snapshot_status, inv_ok AS inventory_state_available, f_reason AS forecast_input_reason,
r_reason AS retrospective_input_reason, {ordered('all_reasons')} AS preparation_unavailable_reasons FROM prep2""",
)
def inv_prepare(spark, sf_dir):
    return _prepared(spark, sf_dir).select(
        *ID,
        "methodology_status",
        "origin_snapshot_status",
        "inventory_state_available",
        "forecast_input_reason",
        "retrospective_input_reason",
        F.array_join("preparation_unavailable_reasons", ";").alias("preparation_unavailable_reasons"),
    )


@query(
    "inv_identity_check",
    "I9",
    with_(whole(PANEL))
    + " UNION ALL ".join(
        f"SELECT '{c}_invalid_identifier' AS \"check\", CAST(count(*) - count(*) AS BIGINT) AS affected FROM panel"
        for c in ("SKU_ID", "Warehouse_ID", "run_id", "evaluation_stage", "evidence_role", "model", "configuration_id")
    )
    + """ UNION ALL SELECT 'duplicate_forecast_records', CAST(COALESCE(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM
(SELECT *, n * 31 + sn * 7 + wn AS k FROM panel) AS p GROUP BY SKU_ID, Warehouse_ID, CASE WHEN k % 37 = 0 THEN 'bad' ELSE CAST(Date AS VARCHAR) END, k % 5 HAVING count(*) > 1) AS q""",
)
def inv_identity_check(spark, sf_dir):
    return iv.identity_defects(defective_records(spark, sf_dir))


CASE_COLUMNS = """origin_state AS origin_exposure_state, forecast_state AS forecast_exposure_state, retro_state AS retrospective_exposure_state,
buffer AS inventory_buffer, p_margin AS predicted_margin, r_margin AS retrospective_margin, cmp AS comparison_case, cell AS confusion_cell"""
CASES = [
    "origin_exposure_state",
    "forecast_exposure_state",
    "retrospective_exposure_state",
    "inventory_buffer",
    "predicted_margin",
    "retrospective_margin",
    "comparison_case",
    "confusion_cell",
]


def _case_query(scenario):
    def run(spark, sf_dir):
        cases = iv.exposure_cases(
            _prepared(spark, sf_dir), "hypothetical balances" if scenario else None
        )
        return cases.select(
            *ID,
            "inventory_basis",
            *CASES,
            F.array_join("evaluation_unavailable_reasons", ";").alias("evaluation_unavailable_reasons"),
        )

    return run


for _key, _ids, _flag in (("exposure_cases", "I10", False), ("scenario_mode", "I11", True)):
    _basis = "constructed_origin_scenario" if _flag else "source_availability"
    query(
        _key,
        _ids,
        with_(*PREP, cases_sql(_flag))
        + f"SELECT {ID_SQL}, '{_basis}' AS inventory_basis, {CASE_COLUMNS}, {ordered('ev')} AS evaluation_unavailable_reasons FROM cases",
    )(_case_query(_flag))


@query(
    "confusion_summary",
    "A24 I12",
    with_(*PREP, cases_sql(False))
    + ", counted AS (SELECT CAST(h3 AS VARCHAR) AS horizon, "
    + "CASE WHEN k % 37 = 0 THEN 'bad' ELSE CAST(d AS VARCHAR) END AS forecast_origin, CAST(ts AS VARCHAR) AS target_start_date, CAST(te AS VARCHAR) AS target_end_date, "
    + SUMMARY_BODY.format(out="h IS NULL OR h NOT IN (1, 7, 14)")
    + " FROM cases GROUP BY 1, 2, 3, 4) SELECT *, "
    + rate_columns()
    + " FROM counted",
)
def confusion_summary(spark, sf_dir):
    _, summary = iv.evaluate(defective_records(spark, sf_dir))
    out = summary.drop(
        "inventory_basis",
        "run_id",
        "evaluation_stage",
        "evidence_role",
        "model",
        "configuration_id",
        "evaluable_paired_case_count",
        "methodology_status",
    )
    return r(out, *RATES)


JOIN_SQL = "SKU_ID, Warehouse_ID, forecast_origin, horizon"


@query(
    "origin_inventory_join",
    "J4",
    with_(*FINAL_SQL, joined_sql("source-confirmed"))
    + f"""SELECT {JOIN_SQL}, round(prediction, 6) AS prediction, snap_date AS Date, Inventory_Level, Reorder_Point, marker AS origin_snapshot_available,
given AS origin_snapshot_unavailable_reason, CASE WHEN prediction >= 0 THEN 'eligible' ELSE 'ineligible' END AS eligibility_status FROM joined""",
)
def origin_inventory_join(spark, sf_dir):
    inv = iv.apply_policy(origin_inventory(spark, sf_dir), "source-confirmed")
    out = iv.forecast_inventory_inputs(final_export(spark, sf_dir), inv).select(
        *iv.CASE_KEY,
        "prediction",
        "Date",
        "Inventory_Level",
        "Reorder_Point",
        "origin_snapshot_available",
        "origin_snapshot_unavailable_reason",
        "eligibility_status",
    )
    return r(out, "prediction")


@query(
    "retrospective_targets",
    "A25",
    with_(*FINAL_SQL)
    + """SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, CASE WHEN present = horizon THEN CAST(total AS BIGINT) END AS observed_target,
CASE WHEN present = horizon THEN 'complete' ELSE 'unavailable' END AS target_status, CAST(horizon AS BIGINT) AS target_expected_days, present AS target_present_days,
CASE WHEN present = horizon THEN '' ELSE 'missing_daily_target_records' END AS target_unavailable_reason FROM retro""",
)
def retrospective_targets(spark, sf_dir):
    return iv.retrospective_targets(final_export(spark, sf_dir), later_sales(spark, sf_dir))


@query(
    "sales_scope_check",
    "A25 S18",
    with_(*FINAL_SQL)
    + """, w AS (SELECT * FROM demand WHERE Date > DATE '1997-11-28' AND Date <= DATE '1997-12-20')
SELECT CAST(0 AS BIGINT) AS unexpected_series_rows, count(*) FILTER (Date <= DATE '1997-12-02' OR Date > DATE '1997-12-16') AS out_of_window_rows, CAST(0 AS BIGINT) AS duplicate_key_rows FROM w""",
)
def sales_scope_check(spark, sf_dir):
    sales = full_demand(spark, sf_dir).where("Date > DATE'1997-11-28' AND Date <= DATE'1997-12-20'")
    return iv.sales_scope_defects(sales, final_export(spark, sf_dir))


@query(
    "paired_target_join",
    "J5",
    with_(*FINAL_SQL, joined_sql("source-confirmed"))
    + f"""SELECT {JOIN_SQL}, observed_target, CASE WHEN observed_target IS NULL THEN 'unavailable' ELSE 'complete' END AS target_status FROM joined WHERE horizon <> 28""",
)
def paired_target_join(spark, sf_dir):
    export = final_export(spark, sf_dir)
    inputs = iv.forecast_inventory_inputs(export, origin_inventory(spark, sf_dir)).where(
        F.col("horizon") != 28
    )
    targets = iv.retrospective_targets(export, later_sales(spark, sf_dir))
    return inputs.join(targets, iv.CASE_KEY, "left").select(
        *iv.CASE_KEY, "observed_target", "target_status"
    )


def _prospective_sql(policy):
    return (
        with_(*FINAL_SQL, final_cases_sql(policy))
        + f"""SELECT {JOIN_SQL}, round(prediction, 6) AS prediction, marker AS origin_snapshot_available, snap_status AS origin_snapshot_status, snap_reason AS origin_snapshot_reason,
usable AS analysis_inventory_state_available, origin_state AS origin_exposure_state, forecast_state AS forecast_exposure_state, buffer AS inventory_buffer, round(p_margin, 6) AS predicted_margin,
f_reason AS forecast_input_reason, CASE WHEN horizon = 28 THEN 'not_approved_for_downstream_use' ELSE 'approved_method' END AS downstream_use_status FROM fcases"""
    )


PROSPECTIVE = [
    *iv.CASE_KEY,
    "prediction",
    "origin_snapshot_available",
    "origin_snapshot_status",
    "origin_snapshot_reason",
    "analysis_inventory_state_available",
    "origin_exposure_state",
    "forecast_exposure_state",
    "inventory_buffer",
    "predicted_margin",
    "forecast_input_reason",
    "downstream_use_status",
]


def _prospective(policy):
    def run(spark, sf_dir):
        view = iv.prospective_view(
            final_export(spark, sf_dir), origin_inventory(spark, sf_dir), policy
        )
        return r(view.select(*PROSPECTIVE), "prediction", "predicted_margin")

    return run


for _policy, _name in (
    ("unknown", "snapshot_policy_unknown"),
    ("source-confirmed", "snapshot_policy_confirmed"),
    ("constructed-origin", "snapshot_policy_constructed"),
):
    query(_name, "I13 P5", _prospective_sql(_policy))(_prospective(_policy))


def _final_summary_sql(policy):
    return (
        with_(*FINAL_SQL, final_cases_sql(policy))
        + ", counted AS (SELECT horizon, model, configuration_id, "
        + SUMMARY_BODY.format(out="horizon NOT IN (1, 7, 14)")
        + " FROM fcases WHERE horizon <> 28 GROUP BY 1, 2, 3)"
    )


@query(
    "exposure_evaluation",
    "I12 I13",
    _final_summary_sql("constructed-origin") + " SELECT *, " + rate_columns() + " FROM counted",
)
def exposure_evaluation(spark, sf_dir):
    _, summary = iv.paired_evaluation(
        final_export(spark, sf_dir),
        origin_inventory(spark, sf_dir),
        later_sales(spark, sf_dir),
        "constructed-origin",
    )
    keep = [c for c in summary.columns if c not in (
        "inventory_basis", "run_id", "evaluation_stage", "evidence_role", "forecast_origin",
        "canonical_config_id", "target_start_date", "target_end_date",
        "evaluable_paired_case_count", "methodology_status")]
    return r(summary.select(*keep), *RATES)


@query(
    "exposure_cases_final",
    "I13 J5",
    with_(*FINAL_SQL, final_cases_sql("source-confirmed"))
    + f"SELECT {JOIN_SQL}, {CASE_COLUMNS.replace('p_margin AS', 'round(p_margin, 6) AS')} FROM fcases WHERE horizon <> 28",
)
def exposure_cases_final(spark, sf_dir):
    cases, _ = iv.paired_evaluation(
        final_export(spark, sf_dir),
        origin_inventory(spark, sf_dir),
        later_sales(spark, sf_dir),
        "source-confirmed",
    )
    return r(cases.select(*iv.CASE_KEY, *CASES), "predicted_margin")


def _long_metrics(policy):
    blocks = []
    parts = {
        "event_prevalence": "CAST(N AS VARCHAR)",
        "missed_crossing_rate": "CAST(TP + FN AS VARCHAR)",
        "false_alert_rate": "CAST(FP + TN AS VARCHAR)",
        "agreement": "CAST(N AS VARCHAR)",
        "precision": "CAST(TP + FP AS VARCHAR)",
        "recall": "CAST(TP + FN AS VARCHAR)",
        "balanced_accuracy": "'positive=' || (TP + FN) || '; negative=' || (TN + FP)",
    }
    for name, denominator in parts.items():
        missing = (
            "unavailable_undefined_class_rate"
            if name == "balanced_accuracy"
            else "unavailable_zero_denominator"
        )
        value = rate_value(name)
        blocks.append(
            f"SELECT horizon, '{name}' AS metric, round({value}, 6) AS value, {denominator} AS denominator, CASE WHEN {value} IS NULL THEN '{missing}' ELSE 'available' END AS status FROM counted"
        )
    return _final_summary_sql(policy) + " UNION ALL ".join(blocks)


@query("metric_denominators", "A28 I14", _long_metrics("source-confirmed"))
def metric_denominators(spark, sf_dir):
    _, summary = iv.paired_evaluation(
        final_export(spark, sf_dir),
        origin_inventory(spark, sf_dir),
        later_sales(spark, sf_dir),
        "source-confirmed",
    )
    return r(iv.metric_long(summary, ["horizon"]), "value")


@query(
    "prospective_state_check",
    "V17",
    with_(*FINAL_SQL, final_cases_sql("constructed-origin"))
    + """SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, rule FROM fcases, (VALUES ('margin'), ('forecast_state'), ('buffer')) AS v(rule)
WHERE (rule = 'margin' AND SKU_ID = 'SMALL' AND p_margin IS NOT NULL)
   OR (rule = 'forecast_state' AND SKU_ID = 'MEDIUM' AND forecast_state = 'no_forecast_crossing')
   OR (rule = 'buffer' AND Warehouse_ID = 'ASIA' AND buffer IS NOT NULL)""",
)
def prospective_state_check(spark, sf_dir):
    view = iv.prospective_view(
        final_export(spark, sf_dir), origin_inventory(spark, sf_dir), "constructed-origin"
    )
    tampered = view.withColumns(
        {
            "predicted_margin": F.when(F.col("SKU_ID") == "SMALL", F.col("predicted_margin") + 1).otherwise(
                F.col("predicted_margin")
            ),
            "forecast_exposure_state": F.when(
                (F.col("SKU_ID") == "MEDIUM")
                & (F.col("forecast_exposure_state") == "no_forecast_crossing"),
                "forecast_crossing",
            ).otherwise(F.col("forecast_exposure_state")),
            "inventory_buffer": F.when(
                F.col("Warehouse_ID") == "ASIA", F.col("inventory_buffer") - 1
            ).otherwise(F.col("inventory_buffer")),
        }
    )
    return iv.rule_violations(tampered, iv.prospective_rules("constructed-origin"), iv.CASE_KEY)


@query(
    "horizon_gate_projection",
    "P6",
    with_(*FINAL_SQL, final_cases_sql("constructed-origin"))
    + f"""SELECT {JOIN_SQL}, CASE WHEN horizon = 28 THEN 'not_approved_for_downstream_use' ELSE 'approved_method' END AS downstream_use_status,
CASE WHEN horizon <> 28 THEN round(prediction, 6) END AS prediction, CASE WHEN horizon <> 28 THEN origin_state END AS origin_exposure_state FROM fcases""",
)
def horizon_gate_projection(spark, sf_dir):
    view = iv.prospective_view(
        final_export(spark, sf_dir), origin_inventory(spark, sf_dir), "constructed-origin"
    ).select(*iv.CASE_KEY, "downstream_use_status", "prediction", "origin_exposure_state")
    gated = ex.gate_by_horizon(view, [*iv.CASE_KEY, "downstream_use_status"])
    return r(gated, "prediction")
