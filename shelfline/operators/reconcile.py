"""Reconciliation of stored evidence against a recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import METRICS, SERIES, Fold
from shelfline.functions.expr import explode_values, finite
from shelfline.functions.grids import grid_difference, multiset_difference
from shelfline.operators import forecast as fc
from shelfline.operators import metrics as me

DIGITS = 9  # double sums are order dependent


def _named(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(check).alias("check"), "violations"
    )


def _rounded(df: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    return df.select(
        *[F.round(c, DIGITS).alias(c) if c in numbers else F.col(c) for c in columns]
    )


METRIC_COLUMNS = ["model", "horizon", "configuration_id", "fold_id", "n_predictions", *METRICS, "metric_status"]
SUMMARY_COLUMNS = ["model", "horizon", "configuration_id", "valid_fold_count", *[f"mean_{m}" for m in METRICS], "selected_configuration", "selection_status"]


def verify_run(
    predictions: DataFrame,
    fold_metrics: DataFrame,
    summary: DataFrame,
    plan: list[tuple],
    folds: list[Fold],
) -> DataFrame:
    """Violations per check; all zero means the stored evidence reproduces.

    Scores, summaries and selections are recomputed from the stored prediction
    rows and compared as multisets in both directions.
    """
    expected = fc.expected_population(predictions, plan)
    scores = me.score(predictions, [*me.SUMMARY_KEYS, "fold_id"])
    selected = me.select_leaders(me.configuration_summary(scores))
    metric_numbers = list(METRICS)
    mean_numbers = [f"mean_{m}" for m in METRICS]
    per_case = predictions.groupBy("fold_id", "horizon", *SERIES).agg(
        F.min("observed_target").alias("lo"),
        F.max("observed_target").alias("hi"),
        F.count_if(F.col("observed_target").isNull()).alias("absent"),
        F.count(F.lit(1)).alias("n"),
    )
    differing = per_case.where(
        (F.col("lo") < F.col("hi"))
        | ((F.col("absent") > 0) & (F.col("absent") < F.col("n")))
    )
    keyed = fc.with_temporal_keys(
        predictions.select(
            "fold_id",
            "horizon",
            F.col("forecast_origin").alias("_o"),
            F.col("target_start_date").alias("_s"),
            F.col("target_end_date").alias("_e"),
        ),
        folds,
    )
    shifted = keyed.where(
        ~(
            F.col("_o").eqNullSafe(F.col("forecast_origin"))
            & F.col("_s").eqNullSafe(F.col("target_start_date"))
            & F.col("_e").eqNullSafe(F.col("target_end_date"))
        )
    )
    parts = [
        _named(
            grid_difference(expected, predictions, fc.POPULATION_KEYS), "prediction_population"
        ),
        _named(differing, "observed_targets_differ_between_candidates"),
        _named(shifted, "temporal_keys"),
        _named(
            multiset_difference(
                _rounded(fold_metrics, METRIC_COLUMNS, metric_numbers),
                _rounded(scores, METRIC_COLUMNS, metric_numbers),
            ),
            "fold_metrics",
        ),
        _named(
            multiset_difference(
                _rounded(summary, SUMMARY_COLUMNS, mean_numbers),
                _rounded(selected, SUMMARY_COLUMNS, mean_numbers),
            ),
            "configuration_summary",
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_final(
    sealed: DataFrame, scored: DataFrame, observations: DataFrame, plan: list[tuple]
) -> DataFrame:
    """Sealed predictions, scored rows and the observation grid must agree."""
    key = ["model", "horizon", "configuration_id", *SERIES]
    joined = sealed.select(*key, F.col("prediction").alias("_sealed")).join(
        scored.select(*key, "prediction", "observed_target"), key, "full_outer"
    )
    changed = joined.where(~F.col("_sealed").eqNullSafe(F.col("prediction")))
    roster = sealed.select(*SERIES).distinct()
    horizons = sorted({row[2] for row in plan})
    wanted = roster.select(
        *SERIES, explode_values([(h,) for h in horizons], ["horizon"]).alias("_h")
    ).select(*SERIES, "_h.horizon")
    actual = F.col("observed_target").cast("double")
    unusable = observations.where(
        ~F.coalesce(finite(actual) & (actual >= 0) & (actual % 1 == 0), F.lit(False))
    )
    parts = [
        _named(
            grid_difference(fc.expected_population(roster, plan), sealed, fc.POPULATION_KEYS),
            "sealed_population",
        ),
        _named(changed, "sealed_predictions_changed"),
        _named(
            grid_difference(wanted, observations, [*SERIES, "horizon"]), "observation_grid"
        ),
        _named(unusable, "actuals_not_whole_counts"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_lineage(fold_rows: DataFrame) -> DataFrame:
    """Facts of each fold's dataset: interval, roster token and parent token."""
    pair = F.xxhash64(*SERIES).cast("decimal(38,0)")
    per_series = fold_rows.groupBy("fold_id", *SERIES).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("Date").alias("_lo"),
        F.max("Date").alias("_hi"),
    )
    return per_series.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("series"),
        F.sum(pair).cast("string").alias("roster_token"),
        F.sum("_n").alias("rows"),
        F.min("_lo").alias("date_min"),
        F.max("_hi").alias("date_max"),
    )


def lineage_checks(lineage: DataFrame, folds: list[Fold]) -> DataFrame:
    """Same roster in every fold, right intervals, all folds present."""
    lo, hi = F.lit(None).cast("date"), F.lit(None).cast("date")
    for f in folds:
        lo = F.when(F.col("fold_id") == f.fold_id, F.lit(f.start)).otherwise(lo)
        hi = F.when(F.col("fold_id") == f.fold_id, F.lit(f.outcome_end)).otherwise(hi)
    wide = lineage.agg(
        (F.count_distinct("roster_token") == 1).alias("same_roster"),
        F.bool_and((F.col("date_min") == lo) & (F.col("date_max") == hi)).alias("right_intervals"),
        (F.count_distinct("fold_id") == len(folds)).alias("all_folds"),
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in wide.columns]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def field_differences(
    left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]
) -> DataFrame:
    """Null-safe comparison of shared fields; one row per differing field."""
    renamed = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in fields], F.lit(1).alias("_in_r"))
    joined = left.select(*keys, *fields, F.lit(1).alias("_in_l")).join(renamed, keys, "full_outer")
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    problems = F.array_compact(
        F.array(
            F.when(~both, F.lit("record_missing_on_one_side")),
            *[
                F.when(both & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c))
                for c in fields
            ],
        )
    )
    return joined.select(*keys, F.explode(problems).alias("field"))


# --- requirement roll-up ----------------------------------------------------


def requirement_rollup(checks: DataFrame, catalogue: list[tuple[str, str]]) -> DataFrame:
    """Requirement outcomes: passed needs at least one check and no failure.

    The failed-check list of a requirement is bounded by the check catalogue.
    """
    exploded = checks.select("check_id", "passed", F.explode("requirements").alias("requirement"))
    grouped = exploded.groupBy("requirement").agg(
        F.count(F.lit(1)).alias("checks_total"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_id")))).alias("_failed"),
    )
    # the catalogue rides on a one-row aggregate, so it needs no input of its own
    listed = checks.agg(F.count(F.lit(1)).alias("_n")).select(
        explode_values(catalogue, ["requirement", "title"]).alias("r")
    ).select("r.*")
    total = F.coalesce("checks_total", F.lit(0).cast("long"))
    failed = F.coalesce("_failed", F.array().cast("array<string>"))
    return listed.join(grouped, "requirement", "left").select(
        "requirement",
        "title",
        F.when((total > 0) & (F.size(failed) == 0), "PASSED").otherwise("FAILED").alias("outcome"),
        total.alias("checks_total"),
        F.array_join(failed, ";").alias("checks_failed"),
    )


def overall_outcome(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.when(F.bool_and(F.col("outcome") == "PASSED"), "PASSED").otherwise("FAILED").alias("overall")
    )


def passed_rules(rows: DataFrame, rules: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """Evaluate named rules over a relation: (check_id, passed, requirements).

    One aggregate pass; a rule passes when it holds on every row.
    """
    wide = rows.agg(
        *[
            F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(name)
            for name, (c, _) in rules.items()
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_id"),
                F.col(name).alias("passed"),
                F.array(*[F.lit(r) for r in requirements]).alias("requirements"),
            )
            for name, (_, requirements) in rules.items()
        ]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")
