"""Backtest queries without model fitting: plan, baselines, scores, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.fixed import MODEL_ORDER, PRIMARY_MODELS, SERIES
from shelfline.functions.grids import grid_difference
from shelfline.operators import features as fe
from shelfline.operators import folds as fo
from shelfline.operators import forecast as fc
from shelfline.operators import metrics as me
from shelfline.plans.backtest_fixture import (
    CANDIDATES_SQL,
    FOLDS,
    RUN,
    SCORE_SQL,
    SELECT_SQL,
    SUMMARY_SQL,
    candidate_predictions,
    final_rows,
    validation_rows,
)
from shelfline.plans.catalog_features import _eligibility_sql
from shelfline.plans.catalog_profile import r
from shelfline.plans.oracle_base import DEMAND, with_
from shelfline.plans.registry import query
from shelfline.sources.panels import full_demand

PLAN = fc.candidate_plan()
TESTED_PLAN = fc.candidate_plan(models=(*PRIMARY_MODELS, "naive", "seasonal_naive"))


@query(
    "configuration_grid",
    "M21 W14",
    with_(DEMAND)
    + """SELECT 'GBM' || lpad(CAST(row_number() OVER (ORDER BY lr, it, md, ss) AS VARCHAR), 3, '0') AS configuration_id, lr AS learning_rate,
it AS boosting_iterations, md AS max_depth, ss AS subsample, (SELECT count(DISTINCT (SKU_ID, Warehouse_ID)) FROM demand) AS series_count
FROM (VALUES (CAST(0.03 AS DOUBLE)), (0.05), (0.1)) AS a(lr), (VALUES (100), (300)) AS b(it), (VALUES (4), (8)) AS c(md), (VALUES (CAST(0.8 AS DOUBLE)), (1.0)) AS d(ss)""",
)
def configuration_grid(spark, sf_dir):
    return fc.grid_table(full_demand(spark, sf_dir))


@query(
    "plan_counts",
    "A23",
    with_(DEMAND)
    + """SELECT role AS evidence_role, n AS candidates, s AS series_count, n * s AS expected_predictions
FROM (VALUES ('primary', CAST(3 * 4 * 24 * 4 AS BIGINT)), ('supportive', 2 * 4 * 4), ('simple_baseline', 2 * 4 * 4)) AS p(role, n),
(SELECT count(DISTINCT (SKU_ID, Warehouse_ID)) AS s FROM demand) AS q""",
)
def plan_counts(spark, sf_dir):
    return fc.plan_counts(full_demand(spark, sf_dir), PLAN)


@query(
    "baseline_history",
    "A29",
    with_(*CANDIDATES_SQL)
    + "SELECT fold_id, SKU_ID, Warehouse_ID, complete, last_value, week_ago_value, week_sum FROM hist",
)
def baseline_history(spark, sf_dir):
    return fc.baseline_history(full_demand(spark, sf_dir), FOLDS)


def _baseline(name):
    return (
        with_(*CANDIDATES_SQL)
        + f"SELECT fold_id, SKU_ID, Warehouse_ID, horizon, round(prediction, 6) AS prediction FROM preds WHERE model = '{name}'"
    )


@query("naive", "M6", _baseline("naive"))
def naive(spark, sf_dir):
    rows = fc.baseline_predictions(fc.baseline_history(full_demand(spark, sf_dir), FOLDS))
    return r(rows.where("model = 'naive'").drop("model"), "prediction")


@query("seasonal_naive", "M7", _baseline("seasonal_naive"))
def seasonal_naive(spark, sf_dir):
    rows = fc.baseline_predictions(fc.baseline_history(full_demand(spark, sf_dir), FOLDS))
    return r(rows.where("model = 'seasonal_naive'").drop("model"), "prediction")


TEMPORAL = "training_start, training_end, forecast_origin, target_start_date, target_end_date"


@query(
    "forecast_rows",
    "M13 M14",
    with_(*CANDIDATES_SQL)
    + f"""SELECT run_id, evaluation_stage, evidence_role, fold_id, model, horizon, configuration_id, canonical_config_id, SKU_ID, Warehouse_ID,
round(prediction, 6) AS prediction, observed_target, 'available' AS prediction_status, 'complete' AS target_status, 'eligible' AS eligibility_status, {TEMPORAL}
FROM frows WHERE fold_id <= 4""",
)
def forecast_rows(spark, sf_dir):
    return r(validation_rows(spark, sf_dir), "prediction")


@query(
    "temporal_keys",
    "M14",
    with_(*CANDIDATES_SQL)
    + f"SELECT fold_id, horizon, {TEMPORAL}, count(*) AS n_rows FROM frows GROUP BY ALL",
)
def temporal_keys(spark, sf_dir):
    rows = fc.with_temporal_keys(candidate_predictions(full_demand(spark, sf_dir), FOLDS), FOLDS)
    return rows.groupBy(
        "fold_id",
        "horizon",
        "training_start",
        "training_end",
        "forecast_origin",
        "target_start_date",
        "target_end_date",
    ).agg(F.count(F.lit(1)).alias("n_rows"))


SCORE_KEYS = [*me.SUMMARY_KEYS, "fold_id"]
SCORED = ("wape", "mae", "rmse", "bias")
METRIC_SELECT = ", ".join(f"round({m}, 6) AS {m}" for m in SCORED)


@query(
    "metrics",
    "A19",
    with_(*CANDIDATES_SQL, SCORE_SQL)
    + f"SELECT {', '.join(SCORE_KEYS)}, n_predictions, {METRIC_SELECT}, round(wape_denominator, 6) AS wape_denominator, metric_status, failure_reason FROM scores WHERE fold_id <= 4",
)
def metrics(spark, sf_dir):
    return r(me.score(validation_rows(spark, sf_dir), SCORE_KEYS), *SCORED, "wape_denominator")


@query(
    "metrics_with_unusable_values",
    "A19",
    with_(*CANDIDATES_SQL)
    + """, v AS (SELECT model, horizon, configuration_id, fold_id,
  CASE WHEN model = 'naive' AND horizon = 7 AND SKU_ID = 'PROMO' THEN NULL ELSE prediction END AS p,
  CASE WHEN horizon = 14 AND SKU_ID = 'SMALL' AND fold_id = 2 THEN NULL WHEN horizon = 1 THEN 0.0 ELSE observed_target END AS y
  FROM frows WHERE evidence_role = 'simple_baseline' AND fold_id <= 4),
s AS (SELECT model, horizon, configuration_id, fold_id, count(*) AS n, count(*) FILTER (y IS NULL) AS ny, count(*) FILTER (p IS NULL) AS np,
  sum(abs(p - y)) AS a, sum(abs(y)) AS d FROM v GROUP BY ALL)
SELECT model, horizon, configuration_id, fold_id, n AS n_predictions, CASE WHEN ny = 0 AND np = 0 THEN round(a / nullif(d, 0), 6) END AS wape,
CASE WHEN ny = 0 AND np = 0 THEN round(a / n, 6) END AS mae,
CASE WHEN ny + np > 0 THEN 'failed' WHEN d = 0 THEN 'undefined_zero_actual_total' ELSE 'valid' END AS metric_status,
CASE WHEN ny > 0 THEN 'nonfinite_actual' WHEN np > 0 THEN 'nonfinite_prediction' WHEN d = 0 THEN 'WAPE denominator is zero.' END AS failure_reason FROM s""",
)
def metrics_with_unusable_values(spark, sf_dir):
    rows = validation_rows(spark, sf_dir).where("evidence_role = 'simple_baseline'")
    broken = rows.withColumns(
        {
            "prediction": F.when(
                ~((F.col("model") == "naive") & (F.col("horizon") == 7) & (F.col("SKU_ID") == "PROMO")),
                F.col("prediction"),
            ),
            "observed_target": F.when(
                (F.col("horizon") == 14) & (F.col("SKU_ID") == "SMALL") & (F.col("fold_id") == 2),
                F.lit(float("nan")),
            )
            .when(F.col("horizon") == 1, 0.0)
            .otherwise(F.col("observed_target")),
        }
    )
    scored = me.score(broken, ["model", "horizon", "configuration_id", "fold_id"])
    return r(
        scored.drop("rmse", "bias", "wape_denominator"), "wape", "mae"
    )


MEANS = [f"mean_{m}" for m in SCORED]
MEANS_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in MEANS)


@query(
    "fold_means",
    "A20",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL)
    + f"""SELECT model, horizon, configuration_id, CAST(4 AS BIGINT) AS expected_fold_count, valid_fold_count, n_predictions, {MEANS_SQL},
CASE WHEN valid_fold_count = 4 THEN 'valid' ELSE 'unavailable' END AS metric_status,
CASE WHEN valid_fold_count <> 4 THEN 'Incomplete or invalid four-fold evidence.' END AS failure_reason, CAST(0 AS BIGINT) AS identity_defects FROM summ""",
)
def fold_means(spark, sf_dir):
    scores = me.score(validation_rows(spark, sf_dir), SCORE_KEYS)
    return r(me.fold_means(scores, ["model", "horizon", "configuration_id"]), *MEANS)


@query(
    "configuration_summary",
    "A21",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL)
    + f"""SELECT {', '.join(me.SUMMARY_KEYS)}, valid_fold_count, n_predictions, {MEANS_SQL},
CASE WHEN evidence_role = 'primary' THEN false END AS selected_configuration,
CASE WHEN evidence_role = 'primary' THEN 'candidate' ELSE 'not_applicable' END AS selection_status, 'pending_human_review' AS review_status FROM summ""",
)
def configuration_summary(spark, sf_dir):
    scores = me.score(validation_rows(spark, sf_dir), SCORE_KEYS)
    out = me.configuration_summary(scores).drop(
        "expected_fold_count", "metric_status", "failure_reason", "identity_defects"
    )
    return r(out, *MEANS)


def _selected(spark, sf_dir):
    scores = me.score(validation_rows(spark, sf_dir), SCORE_KEYS)
    return me.select_leaders(me.configuration_summary(scores))


@query(
    "select_leaders",
    "K3",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL, SELECT_SQL)
    + "SELECT model, horizon, configuration_id, round(mean_wape, 6) AS mean_wape, selected_configuration, selection_status, tied_configuration_ids FROM selected",
)
def select_leaders(spark, sf_dir):
    out = _selected(spark, sf_dir).select(
        "model",
        "horizon",
        "configuration_id",
        "mean_wape",
        "selected_configuration",
        "selection_status",
        "tied_configuration_ids",
    )
    return r(out, "mean_wape")


@query(
    "horizon_leaders",
    "K3",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL, SELECT_SQL)
    + """, lead AS (SELECT * FROM selected WHERE selection_status IN ('validation_leader', 'tied_administrative_representative')),
b AS (SELECT horizon, min(round(mean_wape, 12)) AS w, count(*) AS k FROM lead GROUP BY 1),
t AS (SELECT l.horizon, string_agg(model, ';' ORDER BY CASE model WHEN 'xgboost' THEN 0 WHEN 'lightgbm' THEN 1 ELSE 2 END) AS names, count(*) AS n
  FROM lead l JOIN b ON l.horizon = b.horizon AND round(mean_wape, 12) = w AND k = 3 GROUP BY 1)
SELECT run_id, model, l.horizon, configuration_id, round(mean_wape, 6) AS mean_wape, selection_status, tied_configuration_ids,
CASE WHEN t.n > 1 THEN names ELSE '' END AS tied_primary_models FROM lead l LEFT JOIN t ON l.horizon = t.horizon""",
)
def horizon_leaders(spark, sf_dir):
    return r(me.horizon_leaders(_selected(spark, sf_dir)), "mean_wape")


@query(
    "selection_flag_join",
    "J14",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL, SELECT_SQL)
    + """SELECT f.model, f.horizon, f.configuration_id, f.fold_id, f.SKU_ID, f.Warehouse_ID, round(f.prediction, 6) AS prediction,
s.selected_configuration, s.selection_status FROM frows f JOIN selected s ON s.model = f.model AND s.horizon = f.horizon AND s.configuration_id = f.configuration_id WHERE f.fold_id <= 4""",
)
def selection_flag_join(spark, sf_dir):
    rows = validation_rows(spark, sf_dir)
    selected = me.select_leaders(me.configuration_summary(me.score(rows, SCORE_KEYS)))
    out = me.flag_predictions(rows, selected).select(
        "model",
        "horizon",
        "configuration_id",
        "fold_id",
        *SERIES,
        "prediction",
        "selected_configuration",
        "selection_status",
    )
    return r(out, "prediction")


@query(
    "protocol_order",
    "K4",
    with_(*CANDIDATES_SQL, SCORE_SQL)
    + """SELECT model, horizon, configuration_id, fold_id, evaluation_stage, CASE evaluation_stage WHEN 'validation' THEN 0 ELSE 1 END AS stage_rank,
CASE model WHEN 'xgboost' THEN 0 WHEN 'lightgbm' THEN 1 WHEN 'catboost' THEN 2 WHEN 'ridge' THEN 3 WHEN 'random_forest' THEN 4 WHEN 'naive' THEN 5 ELSE 6 END AS model_rank,
CASE horizon WHEN 1 THEN 0 WHEN 7 THEN 1 WHEN 14 THEN 2 ELSE 3 END AS horizon_rank, metric_status FROM scores""",
)
def protocol_order(spark, sf_dir):
    rows = validation_rows(spark, sf_dir).unionByName(final_rows(spark, sf_dir))
    scores = me.score(rows, SCORE_KEYS)
    return (
        fc.protocol_ranks(scores)
        .orderBy("stage_rank", "model_rank", "horizon_rank", "configuration_id", "fold_id")
        .select(
            "model",
            "horizon",
            "configuration_id",
            "fold_id",
            "evaluation_stage",
            "stage_rank",
            "model_rank",
            "horizon_rank",
            "metric_status",
        )
    )


@query(
    "eligibility_by_model",
    "J15",
    _eligibility_sql(DEMAND, "demand").replace("SELECT fold_id, horizon, SKU_ID, Warehouse_ID, count(*)", "SELECT * FROM (SELECT fold_id, horizon, SKU_ID, Warehouse_ID, count(*)")
    + """) AS c, (VALUES ('xgboost', 'primary'), ('lightgbm', 'primary'), ('catboost', 'primary'), ('ridge', 'supportive'), ('random_forest', 'supportive'),
('naive', 'simple_baseline'), ('seasonal_naive', 'simple_baseline')) AS m(model, evidence_role), (SELECT 'bench-run' AS run_id, 'validation' AS evaluation_stage) AS k
WHERE fold_id <= 4""",
)
def eligibility_by_model(spark, sf_dir):
    counts = fo.eligibility_counts(
        fe.features_and_targets(full_demand(spark, sf_dir)), FOLDS[:4]
    )
    return fc.eligibility_by_model(counts, MODEL_ORDER, RUN)


@query(
    "run_completion",
    "A37",
    with_(*CANDIDATES_SQL, SCORE_SQL)
    + """, roster AS (SELECT * FROM (VALUES ('primary', CAST(1152 AS BIGINT)), ('supportive', 32), ('simple_baseline', 32)) AS t(evidence_role, expected)),
done AS (SELECT evidence_role, count(*) AS completed, bool_and(metric_status = 'valid') AS fine FROM scores WHERE fold_id <= 4 GROUP BY 1)
SELECT evidence_role, COALESCE(completed, 0) AS completed, expected, COALESCE(completed, 0) = expected AS plan_complete,
CASE WHEN fine THEN 'all_valid' ELSE 'unavailable_metrics_present' END AS metric_state FROM roster LEFT JOIN done USING (evidence_role)""",
)
def run_completion(spark, sf_dir):
    return fc.run_completion(me.score(validation_rows(spark, sf_dir), SCORE_KEYS), PLAN)


DAMAGE = "(length(SKU_ID) + length(Warehouse_ID) + horizon + fold_id + CAST(substr(configuration_id, 4) AS INTEGER))"


@query(
    "grid_anti_join",
    "J9 U3",
    with_(*CANDIDATES_SQL)
    + f""", want AS (SELECT DISTINCT model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID FROM frows WHERE fold_id <= 4),
p AS (SELECT *, CASE WHEN evidence_role = 'primary' THEN {DAMAGE} ELSE 1 END AS k FROM frows WHERE fold_id <= 4),
act AS (SELECT model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID FROM p WHERE k % 23 <> 0
  UNION ALL SELECT model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID FROM p WHERE k % 29 = 0 AND k % 23 <> 0
  UNION ALL SELECT model, horizon, configuration_id || '-x', fold_id, SKU_ID, Warehouse_ID FROM p WHERE k % 31 = 0),
c AS (SELECT model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID, count(*) AS n FROM act GROUP BY ALL)
SELECT model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID, CASE WHEN w.SKU_ID_w IS NULL THEN 0 ELSE 1 END AS expected_rows, COALESCE(n, 0) AS actual_rows,
CASE WHEN n IS NULL THEN 'missing' WHEN w.SKU_ID_w IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem
FROM (SELECT *, SKU_ID AS SKU_ID_w FROM want) w FULL JOIN c USING (model, horizon, configuration_id, fold_id, SKU_ID, Warehouse_ID)
WHERE n IS NULL OR SKU_ID_w IS NULL OR n > 1""",
)
def grid_anti_join(spark, sf_dir):
    rows = validation_rows(spark, sf_dir)
    number = F.expr("try_cast(substr(configuration_id, 4) AS INT)")
    k = F.when(
        F.col("evidence_role") == "primary",
        F.length("SKU_ID") + F.length("Warehouse_ID") + F.col("horizon") + F.col("fold_id") + number,
    ).otherwise(1)
    marked = rows.withColumn("k", k)
    kept, extra = F.col("k") % 23 != 0, F.col("k") % 31 == 0
    variants = F.array_compact(
        F.array(
            F.when(kept, F.col("configuration_id")),
            F.when(kept & (F.col("k") % 29 == 0), F.col("configuration_id")),
            F.when(extra, F.concat("configuration_id", F.lit("-x"))),
        )
    )
    actual = marked.withColumn("configuration_id", F.explode(variants))
    expected = fc.expected_population(rows, TESTED_PLAN)
    out = grid_difference(expected, actual, fc.POPULATION_KEYS)
    return out.withColumns(
        {"expected_rows": F.col("expected_rows"), "actual_rows": F.col("actual_rows")}
    )


@query(
    "comparison_matrix",
    "D9",
    with_(*CANDIDATES_SQL, SCORE_SQL, SUMMARY_SQL, SELECT_SQL)
    + """SELECT horizon, round(max(mean_wape) FILTER (model = 'xgboost'), 6) AS xgboost, round(max(mean_wape) FILTER (model = 'lightgbm'), 6) AS lightgbm,
round(max(mean_wape) FILTER (model = 'catboost'), 6) AS catboost, round(max(mean_wape) FILTER (model = 'naive'), 6) AS naive,
round(max(mean_wape) FILTER (model = 'seasonal_naive'), 6) AS seasonal_naive
FROM selected WHERE selection_status IN ('validation_leader', 'tied_administrative_representative', 'not_applicable') GROUP BY 1""",
)
def comparison_matrix(spark, sf_dir):
    chosen = _selected(spark, sf_dir).where(
        F.col("selection_status").isin(
            "validation_leader", "tied_administrative_representative", "not_applicable"
        )
    )
    models = [*PRIMARY_MODELS, "naive", "seasonal_naive"]
    return r(me.wape_matrix(chosen, models), *models)


@query(
    "comparison_matrix_by_fold",
    "D9",
    with_(*CANDIDATES_SQL, SCORE_SQL)
    + """SELECT horizon, fold_id, round(max(wape) FILTER (model = 'naive'), 6) AS naive, round(max(wape) FILTER (model = 'seasonal_naive'), 6) AS seasonal_naive
FROM scores WHERE fold_id <= 4 GROUP BY 1, 2""",
)
def comparison_matrix_by_fold(spark, sf_dir):
    scores = me.score(
        validation_rows(spark, sf_dir).where("evidence_role = 'simple_baseline'"), SCORE_KEYS
    )
    models = ["naive", "seasonal_naive"]
    return r(me.wape_matrix(scores, models, "wape", ("horizon", "fold_id")), *models)


