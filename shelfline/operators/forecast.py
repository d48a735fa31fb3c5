"""Candidate plan, baselines and forecast rows."""

from __future__ import annotations

from datetime import timedelta
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import (
    BASELINE_MODELS,
    GRID_DEPTH,
    GRID_ITERATIONS,
    GRID_LEARNING_RATE,
    GRID_SUBSAMPLE,
    HORIZONS,
    MODEL_ORDER,
    PRIMARY_MODELS,
    SERIES,
    Fold,
    role_of,
)
from shelfline.functions.expr import explode_values
from shelfline.operators.features import last_days

STAGES = ("validation", "final_evaluation")


def configuration_grid() -> list[tuple[str, float, int, int, float]]:
    """The ordered boosting grid: id, learning rate, iterations, depth, subsample."""
    points = product(GRID_LEARNING_RATE, GRID_ITERATIONS, GRID_DEPTH, GRID_SUBSAMPLE)
    return [(f"GBM{i:03d}", *point) for i, point in enumerate(points, start=1)]


def configurations_of(model: str) -> list[str]:
    if model in PRIMARY_MODELS:
        return [row[0] for row in configuration_grid()]
    return ["not_tuned" if model in BASELINE_MODELS else "fixed"]


def candidate_plan(
    models=MODEL_ORDER, horizons=HORIZONS, folds=(1, 2, 3, 4)
) -> list[tuple[str, str, int, str, int]]:
    """Planned candidates: role, model, horizon, configuration, fold."""
    return [
        (role_of(model), model, h, configuration, fold)
        for model in models
        for h in horizons
        for configuration in configurations_of(model)
        for fold in folds
    ]


PLAN_FIELDS = ["evidence_role", "model", "horizon", "configuration_id", "fold_id"]


def attach_plan(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """Every planned candidate on every input row (a literal generator)."""
    return rows.select("*", explode_values(plan, PLAN_FIELDS).alias("_p")).select(
        *rows.columns, "_p.*"
    )


def plan_counts(roster: DataFrame, plan: list[tuple]) -> DataFrame:
    """Planned candidates and expected predictions per role."""
    sizes = roster.select(*SERIES).distinct().agg(F.count(F.lit(1)).alias("series_count"))
    return (
        attach_plan(sizes, plan)
        .groupBy("evidence_role")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.max("series_count").alias("series_count"),
            F.sum("series_count").alias("expected_predictions"),
        )
    )


def grid_table(roster: DataFrame) -> DataFrame:
    """Grid parameters with the prediction population each one implies."""
    sizes = roster.select(*SERIES).distinct().agg(F.count(F.lit(1)).alias("series_count"))
    names = ["configuration_id", "learning_rate", "boosting_iterations", "max_depth", "subsample"]
    return sizes.select(
        explode_values(configuration_grid(), names).alias("g"), "series_count"
    ).select("g.*", "series_count")


# --- baselines --------------------------------------------------------------


def baseline_history(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """Last value, value six days earlier and 7-day sum at each fold's origin.

    ``complete`` is true only for seven present days; an incomplete history has
    no usable values.
    """
    entries = [
        F.when(
            F.col("Date").between(F.lit(f.end - timedelta(days=6)), F.lit(f.end)),
            F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(f.end).alias("origin")),
        )
        for f in folds
    ]
    tagged = panel.where(last_days(folds, 7)).select(
        *SERIES,
        "Date",
        F.col("Units_Sold").cast("double").alias("_u"),
        F.explode(F.array_compact(F.array(*entries))).alias("_f"),
    )
    age = F.datediff(F.col("_f.origin"), F.col("Date"))
    complete = F.count("_u") == 7
    return tagged.groupBy("_f.fold_id", *SERIES).agg(
        complete.alias("complete"),
        F.when(complete, F.max(F.when(age == 0, F.col("_u")))).alias("last_value"),
        F.when(complete, F.max(F.when(age == 6, F.col("_u")))).alias("week_ago_value"),
        F.when(complete, F.sum("_u")).alias("week_sum"),
    )


def naive(horizon: Column) -> Column:
    return horizon * F.col("last_value")


def seasonal_naive(horizon: Column) -> Column:
    return F.when(horizon == 1, F.col("week_ago_value")).otherwise(
        F.col("week_sum") * (horizon / 7)
    )


def baseline_predictions(history: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Both baselines for every horizon, from one origin row per series."""
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")
    wide = history.select("*", h)
    horizon = F.col("horizon")
    entries = F.array(
        F.struct(F.lit("naive").alias("model"), naive(horizon).alias("prediction")),
        F.struct(
            F.lit("seasonal_naive").alias("model"), seasonal_naive(horizon).alias("prediction")
        ),
    )
    return wide.select("fold_id", *SERIES, "horizon", F.explode(entries).alias("e")).select(
        "fold_id", *SERIES, "horizon", "e.model", "e.prediction"
    )


# --- forecast rows ----------------------------------------------------------


def _by_fold(folds: list[Fold], pick) -> Column:
    out = F.lit(None).cast("date")
    for f in folds:
        out = F.when(F.col("fold_id") == f.fold_id, F.lit(pick(f))).otherwise(out)
    return out


def with_temporal_keys(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """Training interval, origin and inclusive target interval of each row."""
    end = _by_fold(folds, lambda f: f.end)
    return rows.select(
        "*",
        _by_fold(folds, lambda f: f.start).alias("training_start"),
        end.alias("training_end"),
        end.alias("forecast_origin"),
        F.date_add(end, 1).alias("target_start_date"),
        F.date_add(end, F.col("horizon")).alias("target_end_date"),
    )


def role_column(model: Column | str = "model") -> Column:
    m = F.col(model) if isinstance(model, str) else model
    return (
        F.when(m.isin(*PRIMARY_MODELS), "primary")
        .when(m.isin(*BASELINE_MODELS), "simple_baseline")
        .otherwise("supportive")
    )


def forecast_rows(
    predictions: DataFrame,
    observed: DataFrame | None,
    folds: list[Fold],
    run_id: str,
    stage: str = "validation",
) -> DataFrame:
    """One evidence row per (candidate, series).

    ``predictions`` has fold_id, series, horizon, model, configuration_id and
    prediction; ``observed`` the realised total per fold, series and horizon, or
    None before outcomes may be read.
    """
    if observed is None:
        joined = predictions.withColumn("observed_target", F.lit(None).cast("double"))
    else:
        target = observed.select("fold_id", *SERIES, "horizon", "observed_target")
        joined = predictions.join(target, ["fold_id", *SERIES, "horizon"], "left")
    shaped = joined.select(
        F.lit(run_id).alias("run_id"),
        F.lit(stage).alias("evaluation_stage"),
        role_column().alias("evidence_role"),
        "fold_id",
        "model",
        "horizon",
        "configuration_id",
        F.when(role_column() == "primary", F.col("configuration_id")).alias("canonical_config_id"),
        *SERIES,
        "prediction",
        "observed_target",
        F.when(F.col("prediction").isNotNull(), "available")
        .otherwise("unavailable")
        .alias("prediction_status"),
        F.when(F.col("observed_target").isNotNull(), "complete")
        .otherwise("unavailable")
        .alias("target_status"),
        F.when(F.col("prediction").isNotNull(), "eligible")
        .otherwise("ineligible")
        .alias("eligibility_status"),
    )
    return with_temporal_keys(shaped, folds)


def protocol_ranks(rows: DataFrame) -> DataFrame:
    """Order columns of the evidence protocol (never the score order)."""
    def rank(c: str, values) -> Column:
        out = F.lit(len(values))
        for i, v in enumerate(values):
            out = F.when(F.col(c) == v, F.lit(i)).otherwise(out)
        return out

    return rows.select(
        "*",
        rank("evaluation_stage", STAGES).alias("stage_rank"),
        rank("model", MODEL_ORDER).alias("model_rank"),
        rank("horizon", HORIZONS).alias("horizon_rank"),
    )


PROTOCOL_ORDER = [
    "stage_rank", "model_rank", "horizon_rank", "configuration_id", "fold_id", *SERIES,
]


def expected_population(roster: DataFrame, plan: list[tuple]) -> DataFrame:
    """Candidate x series keys the evidence must contain exactly once."""
    return attach_plan(roster.select(*SERIES).distinct(), plan)


POPULATION_KEYS = ["model", "horizon", "configuration_id", "fold_id", *SERIES]


def run_completion(scores: DataFrame, plan: list[tuple]) -> DataFrame:
    """Completed against planned candidates per role; a planned role without any score has zero."""
    planned: dict[str, int] = {}
    for role, *_ in plan:
        planned[role] = planned.get(role, 0) + 1
    roster = scores.sparkSession.createDataFrame(sorted(planned.items()), "evidence_role string, expected long")
    done = scores.groupBy("evidence_role").agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("metric_status") == "valid").alias("valid"),
    )
    zero = F.lit(0).cast("long")
    return (
        done.join(F.broadcast(roster), "evidence_role", "full_outer")
        .select(
            "evidence_role",
            F.coalesce("completed", zero).alias("completed"),
            "valid",
            F.coalesce("expected", zero).alias("expected"),
        )
        .select(
            "evidence_role",
            "completed",
            "expected",
            (F.col("completed") == F.col("expected")).alias("plan_complete"),
            F.when(F.col("valid") == F.col("completed"), "all_valid")
            .otherwise("unavailable_metrics_present")
            .alias("metric_state"),
        )
    )


def eligibility_by_model(counts: DataFrame, models, run_id: str) -> DataFrame:
    """Series-level eligibility evidence repeated for every model in scope."""
    roles = [(m, role_of(m)) for m in models]
    return counts.select(
        F.lit(run_id).alias("run_id"),
        F.lit("validation").alias("evaluation_stage"),
        explode_values(roles, ["model", "evidence_role"]).alias("_m"),
        *counts.columns,
    ).select("run_id", "evaluation_stage", "_m.evidence_role", "_m.model", *counts.columns)


