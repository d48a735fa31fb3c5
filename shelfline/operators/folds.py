"""Expanding folds: slices, label boundaries and eligibility evidence.

Folds are a handful of literal date intervals.  They are attached to rows with
an exploding generator over literals, never with a join, and all folds are
handled in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import EXCLUSIONS, FEATURES, HORIZONS, SERIES, Fold
from shelfline.functions.expr import any_of
from shelfline.operators.features import eligible


def fold_struct(fold: Fold) -> Column:
    return F.struct(
        F.lit(fold.fold_id).alias("fold_id"),
        F.lit(fold.start).alias("training_start"),
        F.lit(fold.end).alias("training_end"),
        F.date_add(F.lit(fold.end), 1).alias("outcome_start"),
        F.lit(fold.outcome_end).alias("outcome_end"),
    )


def assign_folds(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows of every fold with their slice: training or validation."""
    f = F.col("_f")
    return (
        rows.withColumn("_f", F.explode(F.array(*[fold_struct(fold) for fold in folds])))
        .where(F.col("Date").between(f["training_start"], f["outcome_end"]))
        .withColumn(
            "slice",
            F.when(F.col("Date") <= f["training_end"], "training").otherwise("validation"),
        )
        .select("*", "_f.*")
        .drop("_f")
    )


def fold_coverage(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """Observed against expected days of each series in both windows of a fold."""
    tagged = assign_folds(panel.select(*SERIES, "Date"), folds)
    training_days = F.datediff("training_end", "training_start") + 1
    outcome_days = F.datediff("outcome_end", "outcome_start") + 1
    in_training = F.col("slice") == "training"
    return (
        tagged.groupBy("fold_id", "training_start", "training_end", "outcome_start", "outcome_end", *SERIES)
        .agg(
            F.count_distinct(F.when(in_training, F.col("Date"))).alias("training_days"),
            F.count_distinct(F.when(~in_training, F.col("Date"))).alias("validation_days"),
        )
        .select(
            "fold_id",
            *SERIES,
            "training_days",
            training_days.cast("long").alias("expected_training_days"),
            "validation_days",
            outcome_days.cast("long").alias("expected_validation_days"),
            (
                (F.col("training_days") == training_days)
                & (F.col("validation_days") == outcome_days)
            ).alias("complete"),
        )
    )


def horizon_rows(prepared: DataFrame) -> DataFrame:
    """Wide targets to one row per horizon, features carried along."""
    entries = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}_day").alias("target"))
            for h in HORIZONS
        ]
    )
    kept = [c for c in prepared.columns if not c.startswith("target_")]
    return prepared.select(*kept, F.explode(entries).alias("_h")).select(
        *kept, "_h.horizon", "_h.target"
    )


def within_boundary() -> Column:
    """The whole target window ends inside the training window."""
    return F.date_add(F.col("Date"), F.col("horizon") - 1) <= F.col("training_end")


def training_rows(prepared: DataFrame, folds: list[Fold]) -> DataFrame:
    """Fold x horizon training rows: eligible features and admissible labels."""
    slim = prepared.where(eligible())
    tagged = assign_folds(slim, folds).where(F.col("slice") == "training")
    return (
        horizon_rows(tagged)
        .where(within_boundary() & F.col("target").isNotNull())
        .select("fold_id", "horizon", *SERIES, "Date", *FEATURES, "target", "training_end")
    )


def eligibility_counts(prepared: DataFrame, folds: list[Fold]) -> DataFrame:
    """Per fold, horizon and series: populations and overlapping exclusions."""
    flagged = prepared.select(
        *SERIES,
        "Date",
        eligible().alias("_ready"),
        *[F.col(f"target_{h}_day") for h in HORIZONS],
    )
    rows = horizon_rows(
        assign_folds(flagged, folds).where(F.col("slice") == "training")
    )
    inside = within_boundary()
    label = F.col("target").isNotNull() & inside
    exclusion = {
        EXCLUSIONS[0]: ~F.col("_ready"),
        EXCLUSIONS[1]: ~inside,
        EXCLUSIONS[2]: inside & F.col("target").isNull(),
    }
    overlap = {
        name: F.bool_or(
            condition & any_of(c for other, c in exclusion.items() if other != name)
        )
        for name, condition in exclusion.items()
    }
    return rows.groupBy("fold_id", "horizon", *SERIES).agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        F.count_if(F.col("_ready")).alias("feature_eligible_count"),
        F.count_if(label).alias("label_eligible_count"),
        F.count_if(label & F.col("_ready")).alias("training_row_count"),
        *[F.count_if(c).alias(name) for name, c in exclusion.items()],
        F.array_join(
            F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in overlap.items()])), ";"
        ).alias("overlapping_reasons"),
    )


def exclusion_rows(counts: DataFrame) -> DataFrame:
    """Eligibility counts in long form, one row per exclusion reason."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("exclusion_reason"), F.col(name).alias("reason_count"))
            for name in EXCLUSIONS
        ]
    )
    kept = [c for c in counts.columns if c not in EXCLUSIONS]
    return counts.select(*kept, F.explode(entries).alias("_e")).select(*kept, "_e.*")


def observed_targets(prepared: DataFrame, folds: list[Fold]) -> DataFrame:
    """Outcome of each fold's origin row (day after the origin), per horizon."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f.fold_id).alias("fold_id"), F.date_add(F.lit(f.end), 1).alias("_start")
            )
            for f in folds
        ]
    )
    starts = [f.end.toordinal() + 1 for f in folds]
    rows = (
        prepared.where(
            F.col("Date").isin([type(folds[0].end).fromordinal(s) for s in starts])
        )
        .withColumn("_f", F.explode(entries))
        .where(F.col("Date") == F.col("_f._start"))
    )
    kept = rows.select(
        F.col("_f.fold_id").alias("fold_id"),
        *SERIES,
        "Date",
        *[F.col(f"target_{h}_day") for h in HORIZONS],
    )
    return horizon_rows(kept).withColumnRenamed("target", "observed_target")
