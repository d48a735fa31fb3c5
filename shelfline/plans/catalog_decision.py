"""Decision-support, review, view and reconciliation queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.fixed import CRITERIA, PRIMARY_MODELS, RATES, SERIES
from shelfline.functions.grids import fingerprint, multiset_difference
from shelfline.operators import decision as de
from shelfline.operators import export as ex
from shelfline.operators import folds as fo
from shelfline.operators import forecast as fc
from shelfline.operators import inventory as iv
from shelfline.operators import metrics as me
from shelfline.operators import reconcile as rc
from shelfline.plans.backtest_fixture import (
    CANDIDATES_SQL,
    FOLDS,
    SCORE_SQL,
    final_rows,
    validation_rows,
)
from shelfline.plans.catalog_backtest import SCORE_KEYS, TESTED_PLAN
from shelfline.plans.catalog_inventory import _final_summary_sql
from shelfline.plans.catalog_profile import r
from shelfline.plans.inventory_fixture import (
    FINAL_SQL,
    final_cases_sql,
    final_export,
    joined_sql,
    later_sales,
    origin_inventory,
    rate_columns,
)
from shelfline.plans.oracle_base import DEMAND, GAP, PANEL, whole, with_
from shelfline.plans.registry import query
from shelfline.session import stored
from shelfline.sources.panels import full_demand, full_panel, gap_panel

POLICY = "constructed-origin"
KEY_SQL = "SKU_ID, Warehouse_ID, forecast_origin, horizon"
NUMBERED = (
    "'F' || lpad(CAST(row_number() OVER (ORDER BY SKU_ID, Warehouse_ID, horizon) AS VARCHAR), "
    "CAST(greatest(2, length(CAST(row_number() OVER (ORDER BY SKU_ID, Warehouse_ID, horizon) AS VARCHAR))) AS INTEGER), '0') AS assessment_id"
)


def _view(spark, sf_dir):
    return iv.prospective_view(final_export(spark, sf_dir), origin_inventory(spark, sf_dir), POLICY)


def _evaluation(spark, sf_dir):
    return iv.paired_evaluation(
        final_export(spark, sf_dir),
        origin_inventory(spark, sf_dir),
        later_sales(spark, sf_dir),
        POLICY,
    )


def _records(spark, sf_dir):
    return de.build_records(final_export(spark, sf_dir), _view(spark, sf_dir))


@query(
    "ds_records",
    "D1 W14 J6",
    with_(*FINAL_SQL, final_cases_sql(POLICY))
    + f"""SELECT {NUMBERED}, {KEY_SQL}, horizon || '-day' AS forecast_horizon, round(prediction, 6) AS forecast_demand,
CASE WHEN usable THEN origin_state END AS origin_exposure_state, CASE WHEN usable THEN forecast_state END AS forecast_exposure_state, buffer AS inventory_buffer,
CASE WHEN NOT usable THEN CASE WHEN horizon = 28 THEN '28_day_downstream_use_requires_separate_approval' ELSE snap_reason END END AS inventory_reason,
CAST(CASE WHEN usable THEN 2 ELSE 4 END AS INTEGER) AS unavailable_fields,
CAST(5 + 5 + 1 + CASE WHEN prediction < 0 THEN 1 ELSE 0 END + CASE WHEN horizon = 28 THEN 1 ELSE 0 END AS INTEGER) AS limitations FROM fcases""",
)
def ds_records(spark, sf_dir):
    rec = _records(spark, sf_dir)
    out = rec.select(
        "assessment_id",
        *iv.CASE_KEY,
        "forecast_horizon",
        "forecast_demand",
        F.col("inventory_risk_evidence.origin_exposure_state").alias("origin_exposure_state"),
        F.col("inventory_risk_evidence.forecast_exposure_state").alias("forecast_exposure_state"),
        F.col("inventory_risk_evidence.inventory_buffer").alias("inventory_buffer"),
        F.element_at("unavailable_fields", F.lit("inventory_risk_evidence")).alias(
            "inventory_reason"
        ),
        F.size("unavailable_fields").alias("unavailable_fields"),
        F.size("limitations").alias("limitations"),
    )
    return r(out, "forecast_demand")


@query(
    "record_numbering",
    "W14",
    with_(*FINAL_SQL) + f"SELECT {NUMBERED}, SKU_ID, Warehouse_ID, horizon FROM fexport",
)
def record_numbering(spark, sf_dir):
    return de.numbered(final_export(spark, sf_dir)).select("assessment_id", *SERIES, "horizon")


@query(
    "record_contract",
    "V18",
    with_(*FINAL_SQL, final_cases_sql(POLICY))
    + """SELECT SKU_ID, Warehouse_ID, horizon, rule FROM fcases, (VALUES ('inventory_risk_evidence_explained'), ('forecast_demand_explained')) AS v(rule)
WHERE (rule = 'forecast_demand_explained' AND Warehouse_ID = 'ASIA') OR (rule = 'inventory_risk_evidence_explained' AND NOT usable AND SKU_ID = 'PROMO')""",
)
def record_contract(spark, sf_dir):
    rec = _records(spark, sf_dir)
    damaged = rec.withColumns(
        {
            "forecast_demand": F.when(F.col("Warehouse_ID") != "ASIA", F.col("forecast_demand")),
            "unavailable_fields": F.when(
                F.col("SKU_ID") == "PROMO",
                F.map_filter("unavailable_fields", lambda k, v: k != "inventory_risk_evidence"),
            ).otherwise(F.col("unavailable_fields")),
        }
    )
    return iv.rule_violations(damaged, de.record_rules(), [*SERIES, "horizon"])


CRITERIA_SQL = ", ".join(f"('{c}', {i})" for i, c in enumerate(CRITERIA))


@query(
    "ds_checklist",
    "D2 J12",
    with_(*FINAL_SQL)
    + f""", f AS (SELECT {NUMBERED}, {KEY_SQL} FROM fexport)
SELECT f.*, c AS criterion, '' AS applicable, '' AS outcome, '' AS reason, '' AS evidence, '' AS assessor, '' AS assessed_on FROM f, (VALUES {CRITERIA_SQL}) AS cr(c, i)""",
)
def ds_checklist(spark, sf_dir):
    return de.checklist(_records(spark, sf_dir))


REVIEWS_SQL = f"""f AS (SELECT {NUMBERED}, {KEY_SQL} FROM fexport),
rv AS (SELECT f.*, c AS criterion, (CAST(substr(assessment_id, 2) AS INTEGER) * 5 + i * 3) AS k FROM f, (VALUES {CRITERIA_SQL}) AS cr(c, i)),
reviews AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'no' ELSE 'yes' END AS applicable,
  CASE WHEN k % 7 = 0 THEN '' WHEN k % 3 = 0 THEN 'met' WHEN k % 3 = 1 THEN 'not met' ELSE 'not assessable' END AS outcome FROM rv)"""


def _reviews(spark, sf_dir):
    """Checklist filled by a rule: applicability, outcome, reasons, evidence."""
    index = F.lit(0)
    for i, c in enumerate(CRITERIA):
        index = F.when(F.col("criterion") == c, i).otherwise(index)
    k = F.expr("CAST(substr(assessment_id, 2) AS INT)") * 5 + index * 3
    sheet = de.checklist(_records(spark, sf_dir)).withColumn("k", k)
    applicable = F.when(F.col("k") % 7 == 0, "no").otherwise("yes")
    outcome = (
        F.when(F.col("k") % 7 == 0, "")
        .when(F.col("k") % 3 == 0, "met")
        .when(F.col("k") % 3 == 1, "not met")
        .otherwise("not assessable")
    )
    return sheet.withColumns(
        {
            "applicable": applicable,
            "outcome": outcome,
            "reason": F.when(outcome != "met", "stated").otherwise(""),
            "evidence": F.when(outcome == "met", "page 1").otherwise(""),
            "assessor": F.lit("reviewer"),
            "assessed_on": F.lit("1998-01-05"),
        }
    )


TALLY_SQL = """tally AS (SELECT criterion, count(*) FILTER (applicable = 'yes') AS applicable, count(*) FILTER (applicable = 'no') AS not_applicable,
  count(*) FILTER (outcome = 'met') AS met, count(*) FILTER (outcome = 'not met') AS not_met, count(*) FILTER (outcome = 'not assessable') AS not_assessable
  FROM reviews GROUP BY 1)"""


@query(
    "ds_tally",
    "D3 A26",
    with_(*FINAL_SQL, REVIEWS_SQL, TALLY_SQL)
    + "SELECT *, round(met / CAST(nullif(applicable, 0) AS DOUBLE), 6) AS met_proportion FROM tally",
)
def ds_tally(spark, sf_dir):
    return r(de.tally(_reviews(spark, sf_dir)), "met_proportion")


@query(
    "count_reconciliation",
    "V19",
    with_(*FINAL_SQL, REVIEWS_SQL, TALLY_SQL)
    + """SELECT criterion, met + not_met + not_assessable = applicable AS outcomes_reconcile,
applicable + not_applicable = (SELECT count(*) FROM fexport) AS records_reconcile FROM tally""",
)
def count_reconciliation(spark, sf_dir):
    return de.tally_reconciliation(de.tally(_reviews(spark, sf_dir)), final_export(spark, sf_dir))


@query(
    "review_validation",
    "A26",
    with_(*FINAL_SQL, REVIEWS_SQL)
    + """SELECT assessment_id, criterion, rule FROM reviews, (VALUES ('assessor'), ('assessed_on'), ('outcome_supported')) AS v(rule)
WHERE (rule = 'assessor' AND k % 11 = 0) OR (rule = 'assessed_on' AND k % 13 = 0) OR (rule = 'outcome_supported' AND k % 17 = 0 AND applicable = 'yes')""",
)
def review_validation(spark, sf_dir):
    k = F.col("k")
    damaged = _reviews(spark, sf_dir).withColumns(
        {
            "assessor": F.when(k % 11 == 0, " ").otherwise(F.col("assessor")),
            "assessed_on": F.when(k % 13 == 0, "1998-1-5").otherwise(F.col("assessed_on")),
            "evidence": F.when(k % 17 == 0, "").otherwise(F.col("evidence")),
            "reason": F.when((k % 17 == 0) & (F.col("applicable") == "yes"), "").otherwise(
                F.col("reason")
            ),
        }
    )
    return iv.rule_violations(damaged, de.review_rules(), ["assessment_id", "criterion"])


@query(
    "review_coverage",
    "A26 J9",
    with_(*FINAL_SQL, REVIEWS_SQL)
    + f"SELECT assessment_id, criterion, {KEY_SQL}, 1 AS expected_rows, 0 AS actual_rows, 'missing' AS problem FROM reviews WHERE k % 19 = 0",
)
def review_coverage(spark, sf_dir):
    reviews = _reviews(spark, sf_dir)
    return de.review_coverage(reviews.where("k % 19 != 0"), de.checklist(_records(spark, sf_dir)))


@query(
    "eligible_pool",
    "P8",
    with_(*FINAL_SQL, final_cases_sql(POLICY))
    + f"""SELECT assessment_id, SKU_ID, Warehouse_ID FROM (SELECT *, {NUMBERED} FROM fcases) AS t WHERE horizon = 7 AND usable AND f_reason = ''""",
)
def eligible_pool(spark, sf_dir):
    return de.eligible_pool(_records(spark, sf_dir)).select("assessment_id", *SERIES)


@query(
    "seeded_pick",
    "P8",
    with_(*FINAL_SQL, final_cases_sql(POLICY))
    + f"""SELECT arg_min(assessment_id, md5('seed-1' || assessment_id)) AS assessment_id, count(*) AS pool_size
FROM (SELECT *, {NUMBERED} FROM fcases) AS t WHERE horizon = 7 AND usable AND f_reason = ''""",
)
def seeded_pick(spark, sf_dir):
    return de.seeded_pick(de.eligible_pool(_records(spark, sf_dir)), "seed-1")


@query(
    "case_lookup",
    "D10",
    with_(*FINAL_SQL)
    + f"SELECT * FROM (SELECT {NUMBERED}, SKU_ID, Warehouse_ID, horizon, horizon || '-day' AS forecast_horizon FROM fexport) AS t WHERE assessment_id = 'F07'",
)
def case_lookup(spark, sf_dir):
    return de.lookup(_records(spark, sf_dir), "F07")


@query(
    "request_history",
    "M19",
    with_(GAP)
    + """SELECT SKU_ID, Warehouse_ID, count(*) AS days, date_diff('day', min(Date), max(Date)) + 1 = count(*) AND max(Date) = DATE '1997-12-02' AS complete,
md5(string_agg(CAST(Date AS VARCHAR) || '=' || Units_Sold, ',' ORDER BY Date)) AS history_md5 FROM gap WHERE Date <= DATE '1997-12-02' GROUP BY 1, 2""",
)
def request_history(spark, sf_dir):
    text = F.array_join(
        F.transform(
            "history",
            lambda e: F.concat(e["Date"].cast("string"), F.lit("="), e["Units_Sold"].cast("string")),
        ),
        ",",
    )
    return de.request_history(gap_panel(spark, sf_dir), date(1997, 12, 2)).select(
        *SERIES, "days", "complete", F.md5(text).alias("history_md5")
    )


@query(
    "retrospective_error",
    "M18",
    with_(*FINAL_SQL, joined_sql(POLICY))
    + f"""SELECT {KEY_SQL}, target_start_date, target_end_date, round(prediction, 6) AS forecast_quantity, observed_target AS actual_units_sold,
round(prediction - observed_target, 6) AS signed_error_prediction_minus_actual, round(abs(prediction - observed_target), 6) AS absolute_error,
round(abs(prediction - observed_target) / nullif(CAST(observed_target AS DOUBLE), 0) * 100, 6) AS absolute_percentage_error,
CASE WHEN observed_target = 0 THEN 'actual_sales_zero' END AS percentage_error_unavailable_reason FROM joined WHERE horizon <> 28""",
)
def retrospective_error(spark, sf_dir):
    export = final_export(spark, sf_dir)
    observed = iv.retrospective_targets(export, later_sales(spark, sf_dir))
    return r(
        de.retrospective_error(export, observed),
        "forecast_quantity",
        "signed_error_prediction_minus_actual",
        "absolute_error",
        "absolute_percentage_error",
    )


@query(
    "observations_scan",
    "S17 S18",
    with_(*FINAL_SQL)
    + """SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, CASE WHEN present = horizon THEN CAST(total AS BIGINT) END AS observed_target FROM retro""",
)
def observations_scan(spark, sf_dir):
    """History and outcomes are separate reads: forecasts are stored before outcomes are scanned."""
    from shelfline.session import stored

    sealed = stored(final_export(spark, sf_dir), "sealed-forecasts")
    outcomes = iv.retrospective_targets(sealed, later_sales(spark, sf_dir))
    return outcomes.select(*iv.CASE_KEY, "observed_target")


# --- views ------------------------------------------------------------------

FINAL_CASES = [*FINAL_SQL, final_cases_sql(POLICY)]


@query(
    "horizon_population",
    "A27",
    with_(*FINAL_SQL)
    + "SELECT forecast_origin, horizon, count(*) AS horizon_forecast_population_count FROM fexport GROUP BY 1, 2",
)
def horizon_population(spark, sf_dir):
    return de.horizon_population(_view(spark, sf_dir))


@query(
    "view_coverage",
    "D4 A27",
    _final_summary_sql(POLICY)
    + """, pop AS (SELECT forecast_origin, horizon, count(*) AS c FROM fexport GROUP BY 1, 2)
SELECT forecast_origin, p.horizon, c AS horizon_forecast_population_count, N, TP, TN, FP, FN, scenario_at_or_below_count, origin_known_at_or_below_count, unavailable_case_count,
forecast_unavailable_or_gated_count, retrospective_unavailable_or_gated_count FROM pop p LEFT JOIN counted k ON k.horizon = p.horizon""",
)
def view_coverage(spark, sf_dir):
    _, summary = _evaluation(spark, sf_dir)
    return de.coverage_view(_view(spark, sf_dir), summary)


@query(
    "view_crossings",
    "D5",
    _final_summary_sql(POLICY) + " SELECT *, " + rate_columns() + " FROM counted",
)
def view_crossings(spark, sf_dir):
    _, summary = _evaluation(spark, sf_dir)
    nested = de.crossings_view(summary)
    out = nested.select(
        F.col("group.horizon").alias("horizon"),
        F.col("group.model").alias("model"),
        F.col("group.configuration_id").alias("configuration_id"),
        "counts.*",
        *[F.round(f"metrics.{m}.value", 6).alias(m) for m in RATES],
        *[F.col(f"metrics.{m}.status").alias(f"{m}_status") for m in RATES],
    )
    rest = summary.select(
        "horizon",
        "origin_known_at_or_below_count",
        "scenario_at_or_below_count",
        "initially_above_threshold_count",
        "forecast_unavailable_or_gated_count",
        "retrospective_unavailable_or_gated_count",
    )
    return out.join(rest, "horizon")


@query(
    "view_margins_prospective",
    "D6",
    with_(*FINAL_CASES)
    + f"SELECT {KEY_SQL}, target_start_date, target_end_date, buffer AS inventory_buffer, origin_state AS origin_exposure_state, round(p_margin, 6) AS predicted_margin, forecast_state AS forecast_exposure_state, f_reason AS forecast_input_reason FROM fcases WHERE horizon <> 28",
)
def view_margins_prospective(spark, sf_dir):
    cases, _ = _evaluation(spark, sf_dir)
    predicted, _ = de.margin_views(_view(spark, sf_dir), cases)
    return r(predicted.drop("inventory_basis"), "predicted_margin")


@query(
    "view_margins_retrospective",
    "D6",
    with_(*FINAL_CASES)
    + f"SELECT {KEY_SQL}, target_start_date, target_end_date, buffer AS inventory_buffer, origin_state AS origin_exposure_state, r_margin AS retrospective_margin, retro_state AS retrospective_exposure_state, r_reason AS retrospective_input_reason FROM fcases WHERE horizon <> 28",
)
def view_margins_retrospective(spark, sf_dir):
    cases, _ = _evaluation(spark, sf_dir)
    _, realised = de.margin_views(_view(spark, sf_dir), cases)
    return realised.drop("inventory_basis")


@query(
    "view_availability",
    "D7 J11 P6",
    with_(*FINAL_CASES)
    + f"""SELECT {KEY_SQL}, CASE WHEN horizon = 28 THEN 'not_approved_for_downstream_use' ELSE 'approved_method' END AS downstream_use_status,
CASE WHEN horizon = 28 THEN '28_day_downstream_use_requires_separate_approval' ELSE '' END AS downstream_use_reason,
CASE WHEN horizon <> 28 THEN round(prediction, 6) END AS prediction, CASE WHEN horizon <> 28 THEN snap_status END AS origin_snapshot_status,
CASE WHEN horizon <> 28 THEN snap_reason END AS origin_snapshot_reason, CASE WHEN horizon <> 28 THEN false END AS inventory_state_available,
CASE WHEN horizon <> 28 THEN CASE WHEN f_reason = '' THEN 'available' ELSE 'unavailable' END END AS forecast_input_status, CASE WHEN horizon <> 28 THEN f_reason END AS forecast_input_reason,
CASE WHEN horizon <> 28 THEN 'available' END AS forecast_status, CASE WHEN horizon <> 28 THEN 'designated_producer' END AS producer_status,
CASE WHEN horizon <> 28 THEN CASE WHEN horizon = 1 THEN 'next_day' ELSE 'cumulative_window' END END AS forecast_type FROM fcases""",
)
def view_availability(spark, sf_dir):
    return r(
        de.availability_view(_view(spark, sf_dir), final_export(spark, sf_dir)), "prediction"
    )


@query(
    "figure_case_index",
    "D8",
    with_(*FINAL_CASES)
    + f"SELECT {KEY_SQL}, target_start_date, target_end_date, model, configuration_id, cmp AS comparison_case, cell AS confusion_cell, round(p_margin, 6) AS predicted_margin, r_margin AS retrospective_margin FROM fcases WHERE horizon <> 28",
)
def figure_case_index(spark, sf_dir):
    cases, _ = _evaluation(spark, sf_dir)
    return r(de.case_index(cases).drop("evaluation_unavailable_reasons"), "predicted_margin")


@query(
    "designated_flag_join",
    "J13 D8",
    with_(*FINAL_SQL, SCORE_SQL)
    + """SELECT model, horizon, configuration_id, round(wape, 6) AS wape,
(horizon, model, configuration_id) IN ((1, 'lightgbm', 'GBM018'), (7, 'lightgbm', 'GBM011'), (14, 'xgboost', 'GBM022'), (28, 'xgboost', 'GBM003')) AS designated_producer
FROM scores WHERE fold_id = 5""",
)
def designated_flag_join(spark, sf_dir):
    rows = final_rows(spark, sf_dir)
    scores = me.score(rows, SCORE_KEYS).select("model", "horizon", "configuration_id", "wape")
    return r(de.mark_designated(scores, ex.build_export(rows)), "wape")


@query(
    "view_evidence_join",
    "J10 J8",
    with_(*FINAL_CASES)
    + """SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, field FROM fcases, (VALUES ('prediction'), ('observed_target')) AS v(field)
WHERE horizon <> 28 AND ((field = 'prediction' AND SKU_ID = 'SMALL' AND horizon = 7) OR (field = 'observed_target' AND SKU_ID = 'PROMO' AND horizon = 14))""",
)
def view_evidence_join(spark, sf_dir):
    """Worked rows against cases and observations: identical values or a named field."""
    cases, _ = _evaluation(spark, sf_dir)
    left = cases.select(*iv.CASE_KEY, "prediction", "observed_target", "target_start_date", "target_end_date")
    tampered = left.withColumns(
        {
            "prediction": F.when(
                (F.col("SKU_ID") == "SMALL") & (F.col("horizon") == 7), F.col("prediction") + 1
            ).otherwise(F.col("prediction")),
            "observed_target": F.when(
                (F.col("SKU_ID") == "PROMO") & (F.col("horizon") == 14),
                F.coalesce(F.col("observed_target"), F.lit(0)) + 1,
            ).otherwise(F.col("observed_target")),
        }
    )
    return rc.field_differences(
        left,
        tampered,
        iv.CASE_KEY,
        ["prediction", "observed_target", "target_start_date", "target_end_date"],
    )


@query(
    "reconcile_four_way",
    "J8 J6",
    with_(*FINAL_CASES)
    + """SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, source, 'prediction' AS field FROM fexport, (VALUES ('prospective'), ('record')) AS v(source)
WHERE (source = 'prospective' AND Warehouse_ID = 'EUROPE' AND horizon = 1) OR (source = 'record' AND SKU_ID = 'LARGE' AND horizon = 28)""",
)
def reconcile_four_way(spark, sf_dir):
    export = final_export(spark, sf_dir)
    view = _view(spark, sf_dir)
    shifted = view.withColumn(
        "prediction",
        F.when(
            (F.col("Warehouse_ID") == "EUROPE") & (F.col("horizon") == 1), F.col("prediction") + 0.5
        ).otherwise(F.col("prediction")),
    )
    records = _records(spark, sf_dir).select(
        *iv.CASE_KEY,
        F.when(
            (F.col("SKU_ID") == "LARGE") & (F.col("horizon") == 28), F.col("forecast_demand") - 1
        )
        .otherwise(F.col("forecast_demand"))
        .alias("prediction"),
    )
    first = rc.field_differences(export, shifted, iv.CASE_KEY, ["prediction"])
    second = rc.field_differences(export, records, iv.CASE_KEY, ["prediction"])
    return first.withColumn("source", F.lit("prospective")).unionByName(
        second.withColumn("source", F.lit("record"))
    )


@query(
    "view_source_check",
    "R5",
    with_(*FINAL_CASES)
    + """SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, 'record_missing_on_one_side' AS field FROM fexport WHERE SKU_ID = 'MEDIUM' AND horizon = 14
UNION ALL SELECT SKU_ID, Warehouse_ID, forecast_origin, horizon, 'model' FROM fexport WHERE Warehouse_ID = 'AFRICA' AND horizon = 7""",
)
def view_source_check(spark, sf_dir):
    export = final_export(spark, sf_dir)
    view = _view(spark, sf_dir)
    damaged = view.where(~((F.col("SKU_ID") == "MEDIUM") & (F.col("horizon") == 14))).withColumn(
        "model",
        F.when(
            (F.col("Warehouse_ID") == "AFRICA") & (F.col("horizon") == 7), "catboost"
        ).otherwise(F.col("model")),
    )
    return rc.field_differences(
        export,
        damaged,
        iv.CASE_KEY,
        ["prediction", "model", "configuration_id", "target_start_date", "target_end_date", "unit"],
    )


# --- run verification -------------------------------------------------------


def _stored_evidence(spark, sf_dir):
    """Evidence as it was written: verification reads tables, never the expressions behind them."""
    rows = stored(validation_rows(spark, sf_dir), "evidence-rows")
    scores = stored(me.score(rows, SCORE_KEYS), "evidence-scores")
    return rows, scores, stored(me.select_leaders(me.configuration_summary(scores)), "evidence-selected")


@query(
    "verify_run",
    "R1",
    with_(DEMAND)
    + """SELECT "check", CAST(0 AS BIGINT) AS violations FROM (VALUES ('prediction_population'), ('observed_targets_differ_between_candidates'), ('temporal_keys'), ('fold_metrics'), ('configuration_summary')) AS v("check")
WHERE EXISTS (SELECT 1 FROM demand)""",
)
def verify_run(spark, sf_dir):
    rows, scores, selected = _stored_evidence(spark, sf_dir)
    return rc.verify_run(rows, scores, selected, TESTED_PLAN, FOLDS)


@query(
    "verify_run_tampered",
    "R1",
    with_(*CANDIDATES_SQL)
    + """, t AS (SELECT * FROM frows WHERE fold_id <= 4)
SELECT 'prediction_population' AS "check", count(*) AS violations FROM t WHERE model = 'naive' AND SKU_ID = 'PROMO' AND horizon = 7
UNION ALL SELECT 'observed_targets_differ_between_candidates', count(DISTINCT (fold_id, horizon, SKU_ID, Warehouse_ID)) FROM t WHERE SKU_ID = 'SMALL' AND horizon = 1 AND fold_id = 2
UNION ALL SELECT 'temporal_keys', count(*) FROM t WHERE model = 'catboost' AND fold_id = 3 AND horizon = 28
UNION ALL SELECT 'fold_metrics', CAST(2 * (4 + 1) AS BIGINT)
UNION ALL SELECT 'configuration_summary', CAST(2 * 2 AS BIGINT)""",
)
def verify_run_tampered(spark, sf_dir):
    rows, scores, selected = _stored_evidence(spark, sf_dir)
    lost = (F.col("model") == "naive") & (F.col("SKU_ID") == "PROMO") & (F.col("horizon") == 7)
    changed = (
        (F.col("model") == "seasonal_naive")
        & (F.col("SKU_ID") == "SMALL")
        & (F.col("horizon") == 1)
        & (F.col("fold_id") == 2)
    )
    moved = (F.col("model") == "catboost") & (F.col("fold_id") == 3) & (F.col("horizon") == 28)
    damaged = rows.where(~lost).withColumns(
        {
            "observed_target": F.when(changed, F.col("observed_target") + 1).otherwise(
                F.col("observed_target")
            ),
            "target_end_date": F.when(moved, F.date_add("target_end_date", 1)).otherwise(
                F.col("target_end_date")
            ),
        }
    )
    return rc.verify_run(damaged, scores, selected, TESTED_PLAN, FOLDS)


@query(
    "verify_final",
    "R2",
    with_(*CANDIDATES_SQL)
    + """, t AS (SELECT * FROM frows WHERE fold_id = 5)
SELECT 'sealed_population' AS "check", CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'sealed_predictions_changed', count(*) FROM t WHERE SKU_ID = 'LARGE' AND horizon = 14 AND model = 'xgboost'
UNION ALL SELECT 'observation_grid', count(DISTINCT (SKU_ID, Warehouse_ID)) FROM t WHERE Warehouse_ID = 'ASIA'
UNION ALL SELECT 'actuals_not_whole_counts', count(DISTINCT (SKU_ID, Warehouse_ID)) FROM t WHERE SKU_ID = 'SMALL'""",
)
def verify_final(spark, sf_dir):
    rows = final_rows(spark, sf_dir)
    plan = fc.candidate_plan(models=(*PRIMARY_MODELS, "naive", "seasonal_naive"), folds=(5,))
    scored = rows.withColumn(
        "prediction",
        F.when(
            (F.col("SKU_ID") == "LARGE") & (F.col("horizon") == 14) & (F.col("model") == "xgboost"),
            F.col("prediction") + 2,
        ).otherwise(F.col("prediction")),
    )
    observed = rows.where("model = 'naive'").select(*SERIES, "horizon", "observed_target")
    damaged = observed.where(
        ~((F.col("Warehouse_ID") == "ASIA") & (F.col("horizon") == 1))
    ).withColumn(
        "observed_target",
        F.when((F.col("SKU_ID") == "SMALL") & (F.col("horizon") == 28), 0.5).otherwise(
            F.col("observed_target")
        ),
    )
    return rc.verify_final(rows, scored, damaged, plan)


@query(
    "fold_lineage",
    "R3",
    with_(DEMAND)
    + """SELECT "check", passed FROM (VALUES ('same_roster', true), ('right_intervals', true), ('all_folds', true)) AS v("check", passed) WHERE EXISTS (SELECT 1 FROM demand)""",
)
def fold_lineage(spark, sf_dir):
    tagged = fo.assign_folds(full_demand(spark, sf_dir), FOLDS[:4])
    return rc.lineage_checks(rc.fold_lineage(tagged), FOLDS[:4])


@query("fingerprint", "R4", None)
def fingerprint_query(spark, sf_dir):
    return fingerprint(full_panel(spark, sf_dir, whole=True), ["SKU_ID", "Warehouse_ID", "Date", "Units_Sold"])


@query(
    "frame_equality",
    "U4 U3",
    with_(whole(PANEL))
    + """, l AS (SELECT Date, SKU_ID, Warehouse_ID, Inventory_Level FROM panel), rr AS (SELECT Date, SKU_ID, Warehouse_ID, CASE WHEN Inventory_Level % 50 = 0 THEN Inventory_Level + 1 ELSE Inventory_Level END AS Inventory_Level FROM panel)
SELECT *, CAST(1 AS BIGINT) AS surplus FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM rr) AS a UNION ALL SELECT *, -1 FROM (SELECT * FROM rr EXCEPT ALL SELECT * FROM l) AS b""",
)
def frame_equality(spark, sf_dir):
    left = full_panel(spark, sf_dir, whole=True).select("Date", *SERIES, "Inventory_Level")
    right = left.withColumn(
        "Inventory_Level",
        F.when(F.col("Inventory_Level") % 50 == 0, F.col("Inventory_Level") + 1).otherwise(
            F.col("Inventory_Level")
        ),
    )
    return multiset_difference(left, right)


CATALOGUE = [
    ("identity", "Series identity is complete"),
    ("window", "Target windows follow the origin"),
    ("quantity", "Quantities are usable"),
    ("exposure", "Exposure follows the balances"),
    ("review", "Records were reviewed"),
]


def _rollup_rules():
    return {
        "ids": (F.col("SKU_ID").isNotNull() & F.col("Warehouse_ID").isNotNull(), ["identity"]),
        "start": (F.col("target_start_date") == F.date_add("forecast_origin", 1), ["window"]),
        "end": (F.col("target_end_date") == F.date_add("forecast_origin", F.col("horizon")), ["window"]),
        "nonnegative": (F.col("prediction") >= 0, ["quantity", "exposure"]),
        "gated": (
            (F.col("horizon") != 28) | (F.col("origin_exposure_state") == "unavailable"),
            ["exposure"],
        ),
    }


_neg = "(SELECT count(*) FROM fexport WHERE prediction < 0) = 0"


@query(
    "requirement_rollup",
    "V20",
    with_(*FINAL_SQL)
    + f"""SELECT * FROM (SELECT 'identity' AS requirement, 'Series identity is complete' AS title, 'PASSED' AS outcome, CAST(1 AS BIGINT) AS checks_total, '' AS checks_failed
UNION ALL SELECT 'window', 'Target windows follow the origin', 'PASSED', 2, ''
UNION ALL SELECT 'quantity', 'Quantities are usable', CASE WHEN {_neg} THEN 'PASSED' ELSE 'FAILED' END, 1, CASE WHEN {_neg} THEN '' ELSE 'nonnegative' END
UNION ALL SELECT 'exposure', 'Exposure follows the balances', CASE WHEN {_neg} THEN 'PASSED' ELSE 'FAILED' END, 2, CASE WHEN {_neg} THEN '' ELSE 'nonnegative' END
UNION ALL SELECT 'review', 'Records were reviewed', 'FAILED', 0, '') AS t""",
)
def requirement_rollup(spark, sf_dir):
    checks = rc.passed_rules(_view(spark, sf_dir), _rollup_rules())
    return rc.requirement_rollup(checks, CATALOGUE)


@query(
    "overall_outcome",
    "V20",
    with_(*FINAL_SQL) + "SELECT CASE WHEN count(*) > 0 THEN 'FAILED' END AS overall FROM fexport",
)
def overall_outcome(spark, sf_dir):
    return rc.overall_outcome(requirement_rollup(spark, sf_dir))


