"""Forecast scores with explicit statuses, fold means and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.fixed import METRICS, PRIMARY_MODELS
from shelfline.functions.expr import all_of, finite, ratio

TIE_DIGITS = 12  # double sums depend on their order; ties are decided at 12 places


def score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WAPE, MAE, RMSE and bias (prediction minus actual) per candidate.

    A single nonfinite value invalidates the whole population of its group; no
    partial-population score exists.
    """
    y, p = F.col("observed_target").cast("double"), F.col("prediction").cast("double")
    y_ok, p_ok = finite(y), finite(p)
    e = F.when(y_ok & p_ok, p - y)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if(~y_ok).alias("_bad_y"),
        F.count_if(~p_ok).alias("_bad_p"),
        F.sum(F.abs(e)).alias("_abs"),
        F.sum(F.when(y_ok, F.abs(y))).alias("_den"),
        F.sum(e * e).alias("_sq"),
        F.sum(e).alias("_sum"),
    )
    n = F.col("n_predictions")
    computed = [F.col(c) for c in ("_abs", "_den", "_sq", "_sum")]
    overflow = ~all_of(finite(c) for c in computed)
    failure = (
        F.when(F.col("_bad_y") > 0, "nonfinite_actual")
        .when(F.col("_bad_p") > 0, "nonfinite_prediction")
        .when(overflow, "numeric_overflow")
    )
    scored = sums.withColumn("_failure", failure)
    good = F.col("_failure").isNull()

    def kept(c: Column) -> Column:
        return F.when(good, c)

    zero = good & (F.col("_den") == 0)
    return scored.select(
        *keys,
        "n_predictions",
        kept(ratio(F.col("_abs"), F.col("_den"))).alias("wape"),
        kept(F.col("_abs") / n).alias("mae"),
        kept(F.sqrt(F.col("_sq") / n)).alias("rmse"),
        kept(F.col("_sum") / n).alias("bias"),
        kept(F.col("_den")).alias("wape_denominator"),
        F.when(~good, "failed")
        .when(zero, "undefined_zero_actual_total")
        .otherwise("valid")
        .alias("metric_status"),
        F.when(zero, "WAPE denominator is zero.").otherwise(F.col("_failure")).alias(
            "failure_reason"
        ),
    )


def score_planned(rows: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """`score`, with a failed row for planned candidates without predictions."""
    scores = planned.select(*keys).distinct().join(score(rows, keys), keys, "left")
    absent = F.col("metric_status").isNull()
    return scores.withColumns(
        {
            "n_predictions": F.coalesce("n_predictions", F.lit(0).cast("long")),
            "failure_reason": F.when(absent, "empty_population").otherwise(
                F.col("failure_reason")
            ),
            "metric_status": F.coalesce("metric_status", F.lit("failed")),
        }
    )


def fold_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted mean of exactly folds 1..4, all valid; otherwise unavailable.

    ``identity_defects`` counts duplicate or foreign fold ids, which callers
    must treat as blocking.
    """
    valid = (F.col("metric_status") == "valid") & all_of(finite(m) for m in METRICS)
    known = F.col("fold_id").isin(1, 2, 3, 4)
    grouped = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(known).alias("_known"),
        F.count_distinct(F.when(known, F.col("fold_id"))).alias("_folds"),
        F.count_if(valid).alias("valid_fold_count"),
        F.sum("n_predictions").alias("n_predictions"),
        *[F.sum(F.when(valid, F.col(m) / 4)).alias(f"_mean_{m}") for m in METRICS],
    )
    complete = (
        (F.col("_folds") == 4) & (F.col("_rows") == 4) & (F.col("valid_fold_count") == 4)
    )
    return grouped.select(
        *keys,
        F.lit(4).cast("long").alias("expected_fold_count"),
        "valid_fold_count",
        "n_predictions",
        *[F.when(complete, F.col(f"_mean_{m}")).alias(f"mean_{m}") for m in METRICS],
        F.when(complete, "valid").otherwise("unavailable").alias("metric_status"),
        F.when(~complete, "Incomplete or invalid four-fold evidence.").alias("failure_reason"),
        ((F.col("_rows") - F.col("_known")) + (F.col("_known") - F.col("_folds"))).alias(
            "identity_defects"
        ),
    )


SUMMARY_KEYS = [
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "model",
    "horizon",
    "configuration_id",
    "canonical_config_id",
]


def configuration_summary(scores: DataFrame) -> DataFrame:
    """Four-fold means per configuration with the role's initial status."""
    primary = F.col("evidence_role") == "primary"
    return fold_means(scores, SUMMARY_KEYS).select(
        "*",
        F.when(primary, F.lit(False)).alias("selected_configuration"),
        F.when(primary, "candidate")
        .when(F.col("evidence_role") == "supportive", "fixed_supportive")
        .otherwise("not_applicable")
        .alias("selection_status"),
        F.lit("pending_human_review").alias("review_status"),
    )


def select_leaders(summary: DataFrame, grid_size: int = 24) -> DataFrame:
    """Summary rows with selection flags set.

    A leader exists only where all grid configurations of a (model, horizon)
    are complete.  Ties share the minimum; the smallest id represents them.
    The window holds one grid (24 rows) per group.
    """
    group = Window.partitionBy("run_id", "evidence_role", "model", "horizon")
    usable = (
        (F.col("metric_status") == "valid")
        & (F.col("valid_fold_count") == 4)
        & finite("mean_wape")
    )
    size = F.count(F.lit(1)).over(group)
    ids = F.size(F.collect_set("canonical_config_id").over(group))
    good = F.sum(F.when(usable, 1).otherwise(0)).over(group)
    complete = (
        (F.col("evidence_role") == "primary")
        & (size == grid_size)
        & (ids == grid_size)
        & (good == grid_size)
    )
    wape = F.round("mean_wape", TIE_DIGITS)
    tied = complete & (wape == F.min(wape).over(group))
    marked = summary.withColumn("_tied", F.coalesce(tied, F.lit(False)))
    tied_ids = F.array_sort(
        F.collect_list(F.when(F.col("_tied"), F.col("canonical_config_id"))).over(group)
    )
    named = marked.withColumn("_ids", tied_ids)
    representative = F.get("_ids", F.lit(0))
    status = (
        F.when(F.size("_ids") == 1, "validation_leader")
        .when(F.col("canonical_config_id") == representative, "tied_administrative_representative")
        .otherwise("tied_configuration")
    )
    return named.withColumns(
        {
            "selected_configuration": F.when(F.col("_tied"), F.lit(True)).otherwise(
                F.col("selected_configuration")
            ),
            "selection_status": F.when(F.col("_tied"), status).otherwise(
                F.col("selection_status")
            ),
            "tied_configuration_ids": F.when(
                F.col("_tied") & (F.size("_ids") > 1), F.array_join("_ids", ";")
            ),
        }
    ).drop("_tied", "_ids")


def horizon_leaders(selected: DataFrame) -> DataFrame:
    """One representative per (model, horizon) and the tied models per horizon."""
    leaders = selected.where(
        F.col("selection_status").isin("validation_leader", "tied_administrative_representative")
    )
    by_horizon = Window.partitionBy("run_id", "horizon")  # one row per primary model
    wape = F.round("mean_wape", TIE_DIGITS)
    order = {m: i for i, m in enumerate(PRIMARY_MODELS)}
    rank = F.lit(len(order))
    for model, i in order.items():
        rank = F.when(F.col("model") == model, F.lit(i)).otherwise(rank)
    full = F.count(F.lit(1)).over(by_horizon) == len(PRIMARY_MODELS)
    best = wape == F.min(wape).over(by_horizon)
    flagged = leaders.withColumn(
        "_best", F.when(full & best, F.struct(rank.alias("r"), F.col("model").alias("m")))
    )
    names = F.transform(
        F.array_sort(F.collect_list("_best").over(by_horizon)), lambda s: s["m"]
    )
    return flagged.withColumn("_names", names).select(
        "run_id",
        "model",
        "horizon",
        "configuration_id",
        "mean_wape",
        "selection_status",
        "tied_configuration_ids",
        F.when(F.size("_names") > 1, F.array_join("_names", ";"))
        .otherwise("")
        .alias("tied_primary_models"),
    )


def flag_predictions(predictions: DataFrame, selected: DataFrame) -> DataFrame:
    """Copy selection flags from the summary to every prediction row."""
    flags = selected.select(
        "model", "horizon", "configuration_id", "selected_configuration", "selection_status"
    )
    return predictions.join(flags, ["model", "horizon", "configuration_id"], "left")


def wape_matrix(summary: DataFrame, models: list[str], value: str = "mean_wape", keys=("horizon",)) -> DataFrame:
    """Horizon x model matrix of stored values; nothing is recomputed."""
    return summary.groupBy(*keys).pivot("model", models).agg(F.first(value))
