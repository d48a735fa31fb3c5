"""Leakage-safe calendar features and cumulative horizon targets.

Every calculation is a RANGE frame over one window specification
``(series ORDER BY day number)``.  Catalyst therefore plans a single exchange
and a single sort for all lags, rolling statistics, slopes and targets.  A
series is bounded by its calendar (one row per day), so the window partition
stays small whatever the transaction volume behind it was.
"""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shelfline.fixed import (
    FEATURES,
    HORIZONS,
    LAGS,
    ROLLING_WINDOWS,
    SERIES,
    SLOPE_WINDOW,
    Fold,
)
from shelfline.functions.expr import all_of, finite
from shelfline.sources.panels import day_no

# sum of squared centred indices 0..13
SLOPE_DENOMINATOR = SLOPE_WINDOW * (SLOPE_WINDOW**2 - 1) / 12
SLOPE_CENTRE = (SLOPE_WINDOW + 1) / 2


def series_window() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("_day")


def units_until(history_end: date | None, units: str = "Units_Sold") -> Column:
    """Demand with everything after the origin masked before any other use."""
    u = F.col(units).cast("double")
    if history_end is None:
        return u
    return F.when(F.col("Date") <= F.lit(history_end), u)


def calendar_phase(c: Column) -> dict[str, Column]:
    phase = F.weekday(c) * (2 * math.pi / 7)
    return {"dow_sin": F.sin(phase), "dow_cos": F.cos(phase)}


def feature_columns(units: Column, w: WindowSpec) -> dict[str, Column]:
    """The twelve numeric features as window expressions over ``w``."""
    out = calendar_phase(F.col("Date"))
    for lag in LAGS:
        out[f"lag_{lag}"] = F.max(units).over(w.rangeBetween(-lag, -lag))
    for size in ROLLING_WINDOWS:
        frame = w.rangeBetween(-size, -1)
        complete = F.count(units).over(frame) == size
        out[f"rolling_mean_{size}"] = F.when(complete, F.avg(units).over(frame))
        out[f"rolling_std_{size}"] = F.when(complete, F.stddev_samp(units).over(frame))
    frame = w.rangeBetween(-SLOPE_WINDOW, -1)
    weighted = F.sum(units * F.col("_day")).over(frame)
    total = F.sum(units).over(frame)
    out["rolling_slope_14"] = F.when(
        F.count(units).over(frame) == SLOPE_WINDOW,
        (weighted - (F.col("_day") - SLOPE_CENTRE) * total) / SLOPE_DENOMINATOR,
    )
    return out


def build_features(panel: DataFrame, history_end: date | None = None) -> DataFrame:
    """One feature row per panel row; unavailable history is NULL, never filled."""
    framed = panel.select(
        *SERIES, "Date", units_until(history_end).alias("_u"), day_no().alias("_day")
    )
    columns = feature_columns(F.col("_u"), series_window())
    return framed.select(*SERIES, "Date", *[columns[name].alias(name) for name in FEATURES])


def target_columns(units: Column, w: WindowSpec) -> dict[str, Column]:
    out = {}
    for h in HORIZONS:
        frame = w.rangeBetween(0, h - 1)
        out[f"target_{h}_day"] = F.when(
            F.count(units).over(frame) == h, F.sum(units).over(frame)
        )
    return out


def build_targets(panel: DataFrame, window_start: date, window_end: date) -> DataFrame:
    """Cumulative outcomes from each row's own date, complete windows only."""
    inside = F.col("Date").between(F.lit(window_start), F.lit(window_end))
    framed = panel.select(
        *SERIES,
        "Date",
        F.when(inside, F.col("Units_Sold").cast("double")).alias("_u"),
        day_no().alias("_day"),
    )
    columns = target_columns(F.col("_u"), series_window())
    return framed.select(*SERIES, "Date", *[c.alias(n) for n, c in columns.items()])


def features_and_targets(panel: DataFrame) -> DataFrame:
    """Features and unrestricted targets in one pass (one exchange, one sort).

    A target is admissible for a training window exactly when its last day lies
    inside the window, so fold restrictions are applied afterwards as a date
    predicate and nothing has to be recomputed per fold.
    """
    framed = panel.select(
        *SERIES, "Date", F.col("Units_Sold").cast("double").alias("_u"), day_no().alias("_day")
    )
    w = series_window()
    columns = {**feature_columns(F.col("_u"), w), **target_columns(F.col("_u"), w)}
    return framed.select(*SERIES, "Date", *[c.alias(n) for n, c in columns.items()])


def eligible() -> Column:
    """All twelve features present and finite."""
    return all_of(finite(name) for name in FEATURES)


def _folds_at_origin(folds: list[Fold], days: int) -> Column:
    """Fold structs whose last ``days`` training days contain the row's date."""
    entries = [
        F.when(
            F.col("Date").between(
                F.lit(fold.end - timedelta(days=days - 1)), F.lit(fold.end)
            ),
            F.struct(
                F.lit(fold.fold_id).alias("fold_id"),
                F.lit(fold.end).alias("origin"),
                F.lit((fold.end - date(1970, 1, 1)).days).cast("long").alias("origin_day"),
            ),
        )
        for fold in folds
    ]
    return F.explode(F.array_compact(F.array(*entries)))


def last_days(folds: list[Fold], days: int) -> Column:
    """Dates among the last ``days`` training days of any fold; plain ranges, so that scans prune."""
    out = F.lit(False)
    for fold in folds:
        out = out | F.col("Date").between(F.lit(fold.end - timedelta(days=days - 1)), F.lit(fold.end))
    return out


def origin_features(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """One fixed-origin vector per (fold, series) at the day after the origin.

    Only the last 28 training days matter, so this is a conditional aggregate
    over that slice: the date predicate reaches the scan and the shuffle carries
    partial sums rather than rows.  Series seen before the origin but missing
    from its last 28 days keep a row with unavailable features.
    """
    size = max(ROLLING_WINDOWS)
    framed = panel.select(
        *SERIES, "Date", F.col("Units_Sold").cast("double").alias("_u"), day_no().alias("_day")
    )
    tagged = framed.where(last_days(folds, size)).select(*SERIES, "_u", "_day", _folds_at_origin(folds, size).alias("_f"))
    u = F.col("_u")
    age = F.col("_f.origin_day") + 1 - F.col("_day")  # 1 = the origin day
    aggregates = [F.max(F.when(age == lag, u)).alias(f"lag_{lag}") for lag in LAGS]
    for w in ROLLING_WINDOWS:
        inside = F.when(age <= w, u)
        complete = F.count(inside) == w
        aggregates += [
            F.when(complete, F.avg(inside)).alias(f"rolling_mean_{w}"),
            F.when(complete, F.stddev_samp(inside)).alias(f"rolling_std_{w}"),
        ]
    recent = F.when(age <= SLOPE_WINDOW, u)
    aggregates.append(
        F.when(
            F.count(recent) == SLOPE_WINDOW,
            (SLOPE_CENTRE * F.sum(recent) - F.sum(recent * age)) / SLOPE_DENOMINATOR,
        ).alias("rolling_slope_14")
    )
    vectors = tagged.groupBy("_f.fold_id", "_f.origin", *SERIES).agg(*aggregates)
    silent = series_by_fold(framed, folds).join(
        vectors.select("fold_id", *SERIES), ["fold_id", *SERIES], "left_anti"
    )
    dated = vectors.unionByName(silent, allowMissingColumns=True).withColumn(
        "Date", F.date_add("origin", 1)
    )
    for name, c in calendar_phase(F.col("Date")).items():
        dated = dated.withColumn(name, c)
    return dated.select("fold_id", *SERIES, "Date", *FEATURES)


def origin_features_by_window(panel: DataFrame, origin: date) -> DataFrame:
    """Same vectors through the history-plus-origin-row union (for comparison)."""
    history = panel.where(F.col("Date") <= F.lit(origin)).select(*SERIES, "Date", "Units_Sold")
    rows = history.select(*SERIES).distinct().withColumn("Date", F.date_add(F.lit(origin), 1))
    both = history.unionByName(rows, allowMissingColumns=True)
    return build_features(both, history_end=origin).where(
        F.col("Date") == F.date_add(F.lit(origin), 1)
    )


def series_by_fold(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """Series present at or before each fold's origin, from one aggregate."""
    firsts = panel.groupBy(*SERIES).agg(F.min("Date").alias("_first"))
    entries = F.array(
        *[
            F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(f.end).alias("origin"))
            for f in folds
        ]
    )
    return (
        firsts.withColumn("_f", F.explode(entries))
        .where(F.col("_first") <= F.col("_f.origin"))
        .select("_f.fold_id", "_f.origin", *SERIES)
    )
