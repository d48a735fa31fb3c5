"""Deterministic candidate predictions derived from the panel.

Boosting candidates are the seasonal baseline scaled by a small rule of the
configuration number, so that a complete plan (every role, configuration and
fold) can be scored, selected, exported and verified against SQL without
fitting a model.  Configurations come in equal pairs, which produces exact ties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.fixed import PRIMARY_MODELS, SERIES, fold_calendar
from shelfline.operators import features as fe
from shelfline.operators import folds as fo
from shelfline.operators import forecast as fc
from shelfline.plans.catalog_features import FOLD_TABLE, target_sql
from shelfline.plans.oracle_base import PANEL
from shelfline.sources.panels import FULL_END, FULL_START, published_demand

FOLDS = fold_calendar(1997)
RUN = "bench-run"
CONFIGS = [(name, i) for i, (name, *_) in enumerate(fc.configuration_grid(), start=1)]


def candidate_predictions(demand, folds, producers=None):
    """Primary grid plus both baselines for each fold.

    ``producers`` restricts the candidates to designated ones before any row is
    made for the others.
    """
    history = fc.baseline_history(demand, folds)
    base = fc.baseline_predictions(history)
    baselines = base.withColumn("configuration_id", F.lit("not_tuned"))
    grid = F.array(
        *[
            F.struct(
                F.lit(model).alias("m"),
                F.lit(name).alias("c"),
                F.lit(1 + (((i + 1) // 2 * 7 + k * 5) % 11 - 5) / 100).alias("f"),
            )
            for k, model in enumerate(PRIMARY_MODELS)
            for name, i in CONFIGS
            if producers is None or any((model, name) == p[1:] for p in producers)
        ]
    )
    primary = (
        base.where("model = 'seasonal_naive'")
        .withColumn("g", F.explode(grid))
        .select(
            "fold_id",
            *SERIES,
            "horizon",
            F.col("g.m").alias("model"),
            (F.col("prediction") * F.col("g.f")).alias("prediction"),
            F.col("g.c").alias("configuration_id"),
        )
    )
    if producers is not None:
        return primary
    return primary.unionByName(baselines)


def validation_rows(spark, sf_dir):
    demand = published_demand(spark, sf_dir)
    observed = fo.observed_targets(fe.build_targets(demand, FULL_START, FULL_END), FOLDS[:4])
    return fc.forecast_rows(candidate_predictions(demand, FOLDS[:4]), observed, FOLDS, RUN)


def sealed_rows(spark, sf_dir, producers=None):
    """Final forecasts from history alone: no scan of anything after the origin."""
    demand = published_demand(spark, sf_dir)
    predictions = candidate_predictions(demand, FOLDS[4:], producers)
    return fc.forecast_rows(predictions, None, FOLDS, RUN, "final_evaluation")


def final_rows(spark, sf_dir, producers=None):
    demand = published_demand(spark, sf_dir)
    observed = fo.observed_targets(fe.build_targets(demand, FULL_START, FULL_END), FOLDS[4:])
    return fc.forecast_rows(
        candidate_predictions(demand, FOLDS[4:], producers),
        observed,
        FOLDS,
        RUN,
        "final_evaluation",
    )


_MODEL_VALUES = ", ".join(f"('{m}', {k})" for k, m in enumerate(PRIMARY_MODELS))
_CONFIG_VALUES = ", ".join(f"('{n}', {i})" for n, i in CONFIGS)

CANDIDATES_SQL = [
    PANEL,
    FOLD_TABLE,
    target_sql("demand"),
    """hist AS (SELECT fold_id, training_start, training_end, SKU_ID, Warehouse_ID, count(Units_Sold) = 7 AS complete,
  CAST(max(Units_Sold) FILTER (Date = training_end) AS DOUBLE) AS last_value,
  CAST(max(Units_Sold) FILTER (Date = training_end - 6) AS DOUBLE) AS week_ago_value,
  CAST(sum(Units_Sold) AS DOUBLE) AS week_sum
  FROM demand JOIN folds ON Date BETWEEN training_end - 6 AND training_end GROUP BY 1, 2, 3, 4, 5)""",
    """obs AS (SELECT fold_id, SKU_ID, Warehouse_ID, h AS horizon,
  CASE h WHEN 1 THEN target_1_day WHEN 7 THEN target_7_day WHEN 14 THEN target_14_day ELSE target_28_day END AS observed_target
  FROM targets JOIN folds ON Date = training_end + 1, (VALUES (1), (7), (14), (28)) AS hz(h))""",
    """base AS (SELECT fold_id, training_start, training_end, SKU_ID, Warehouse_ID, h AS horizon,
  h * last_value AS naive, CASE WHEN h = 1 THEN week_ago_value ELSE week_sum * (h / CAST(7 AS DOUBLE)) END AS seasonal
  FROM hist, (VALUES (1), (7), (14), (28)) AS hz(h))""",
    f"""preds AS (
  SELECT fold_id, training_start, training_end, SKU_ID, Warehouse_ID, horizon, m AS model, c AS configuration_id, 'primary' AS evidence_role,
    c AS canonical_config_id, seasonal * (1 + (((i + 1) // 2 * 7 + k * 5) % 11 - 5) / CAST(100 AS DOUBLE)) AS prediction
  FROM base, (VALUES {_MODEL_VALUES}) AS mm(m, k), (VALUES {_CONFIG_VALUES}) AS cc(c, i)
  UNION ALL SELECT fold_id, training_start, training_end, SKU_ID, Warehouse_ID, horizon, 'naive', 'not_tuned', 'simple_baseline', NULL, naive FROM base
  UNION ALL SELECT fold_id, training_start, training_end, SKU_ID, Warehouse_ID, horizon, 'seasonal_naive', 'not_tuned', 'simple_baseline', NULL, seasonal FROM base)""",
    """frows AS (SELECT 'bench-run' AS run_id, CASE WHEN fold_id = 5 THEN 'final_evaluation' ELSE 'validation' END AS evaluation_stage,
  p.*, training_end AS forecast_origin, training_end + 1 AS target_start_date, training_end + CAST(horizon AS INTEGER) AS target_end_date, observed_target
  FROM preds p LEFT JOIN obs USING (fold_id, SKU_ID, Warehouse_ID, horizon))""",
]
SCORE_SQL = """scores AS (SELECT run_id, evaluation_stage, evidence_role, model, horizon, configuration_id, canonical_config_id, fold_id,
  training_start, training_end, forecast_origin, target_start_date, target_end_date, count(*) AS n_predictions,
  sum(abs(prediction - observed_target)) / nullif(sum(abs(observed_target)), 0) AS wape,
  sum(abs(prediction - observed_target)) / count(*) AS mae,
  sqrt(sum((prediction - observed_target) ** 2) / count(*)) AS rmse,
  sum(prediction - observed_target) / count(*) AS bias, sum(abs(observed_target)) AS wape_denominator,
  CASE WHEN sum(abs(observed_target)) = 0 THEN 'undefined_zero_actual_total' ELSE 'valid' END AS metric_status,
  CASE WHEN sum(abs(observed_target)) = 0 THEN 'WAPE denominator is zero.' END AS failure_reason
  FROM frows GROUP BY ALL)"""
SUMMARY_SQL = """summ AS (SELECT run_id, evaluation_stage, evidence_role, model, horizon, configuration_id, canonical_config_id,
  count(*) FILTER (metric_status = 'valid') AS valid_fold_count, CAST(sum(n_predictions) AS BIGINT) AS n_predictions,
  CASE WHEN count(*) FILTER (metric_status = 'valid') = 4 THEN sum(wape / 4) END AS mean_wape,
  CASE WHEN count(*) FILTER (metric_status = 'valid') = 4 THEN sum(mae / 4) END AS mean_mae,
  CASE WHEN count(*) FILTER (metric_status = 'valid') = 4 THEN sum(rmse / 4) END AS mean_rmse,
  CASE WHEN count(*) FILTER (metric_status = 'valid') = 4 THEN sum(bias / 4) END AS mean_bias
  FROM scores WHERE fold_id <= 4 GROUP BY ALL)"""
SELECT_SQL = """gridded AS (SELECT *, min(round(mean_wape, 12)) OVER g AS best, count(mean_wape) OVER g AS complete FROM summ
  WINDOW g AS (PARTITION BY model, horizon)),
ties AS (SELECT model, horizon, min(configuration_id) AS rep, count(*) AS n, string_agg(configuration_id, ';' ORDER BY configuration_id) AS ids
  FROM gridded WHERE evidence_role = 'primary' AND complete = 24 AND round(mean_wape, 12) = best GROUP BY 1, 2),
chosen AS (SELECT g.*, evidence_role = 'primary' AND complete = 24 AND round(mean_wape, 12) = best AS tied, rep, n, ids
  FROM gridded g LEFT JOIN ties USING (model, horizon)),
selected AS (SELECT *, CASE WHEN evidence_role = 'primary' THEN tied END AS selected_configuration,
  CASE WHEN evidence_role = 'simple_baseline' THEN 'not_applicable' WHEN NOT tied THEN 'candidate' WHEN n = 1 THEN 'validation_leader'
    WHEN configuration_id = rep THEN 'tied_administrative_representative' ELSE 'tied_configuration' END AS selection_status,
  CASE WHEN tied AND n > 1 THEN ids END AS tied_configuration_ids FROM chosen)"""
