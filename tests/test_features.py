"""Features and targets against hand-written values and leakage properties."""

import math
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, fold_calendar
from shelfline.operators import features as fe
from shelfline.operators import folds as fo

SCHEMA = "SKU_ID string, Warehouse_ID string, Date date, Units_Sold long"


def series(spark, values, start=date(2024, 1, 1), sku="A", skip=()):
    rows = [
        (sku, "W1", start + timedelta(days=i), v) for i, v in enumerate(values) if i not in skip
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_date(df):
    return {r["Date"]: r for r in df.collect()}


def test_feature_values(spark):
    rows = by_date(fe.build_features(series(spark, range(1, 41))))
    r = rows[date(2024, 2, 5)]  # offset 35, units 36
    assert (r.lag_1, r.lag_7, r.lag_14) == (35, 29, 22)
    assert math.isclose(r.rolling_mean_7, 32)
    assert math.isclose(r.rolling_std_7, np.std(range(29, 36), ddof=1))
    assert math.isclose(r.rolling_mean_28, np.mean(range(8, 36)))
    assert math.isclose(r.rolling_slope_14, 1.0)
    assert math.isclose(r.dow_sin, 0, abs_tol=1e-12)  # a Monday
    assert rows[date(2024, 1, 28)].rolling_mean_28 is None
    assert rows[date(2024, 1, 29)].rolling_mean_28 is not None


def test_gap_is_never_bridged(spark):
    rows = by_date(fe.build_features(series(spark, range(40), skip={20})))
    assert rows[date(2024, 1, 22)].lag_1 is None
    assert rows[date(2024, 1, 22)].rolling_mean_7 is None
    assert rows[date(2024, 1, 27)].rolling_mean_7 is None
    assert rows[date(2024, 1, 29)].rolling_mean_7 is not None


def test_future_values_do_not_change_features(spark):
    origin = date(2024, 2, 1)
    base = series(spark, range(40))
    changed = base.withColumn(
        "Units_Sold", F.when(F.col("Date") > F.lit(origin), 999).otherwise(F.col("Units_Sold"))
    )
    a = fe.build_features(base, origin).orderBy("Date").collect()
    b = fe.build_features(changed, origin).orderBy("Date").collect()
    assert a == b


def test_origin_features_match_the_window_form(spark):
    panel = series(spark, [(7 * i) % 11 for i in range(80)])
    fold = fold_calendar(2024)[0]
    fold.end = date(2024, 3, 10)
    fast = fe.origin_features(panel, [fold]).collect()
    slow = fe.origin_features_by_window(panel, fold.end).collect()
    assert len(fast) == len(slow) == 1
    for name in FEATURES:
        assert math.isclose(fast[0][name], slow[0][name], abs_tol=1e-9), name


def test_silent_series_keeps_an_ineligible_origin_row(spark):
    panel = series(spark, range(10))
    fold = fold_calendar(2024)[0]
    rows = fe.origin_features(panel, [fold]).collect()
    assert len(rows) == 1 and rows[0].lag_1 is None


def test_targets_stay_inside_their_window(spark):
    rows = by_date(
        fe.build_targets(series(spark, [1] * 40), date(2024, 1, 1), date(2024, 1, 20))
    )
    assert rows[date(2024, 1, 14)].target_7_day == 7
    assert rows[date(2024, 1, 15)].target_7_day is None
    assert rows[date(2024, 1, 21)].target_1_day is None


def test_training_row_counts_follow_the_closed_form(spark):
    """Feasible rows of a gap-free series: days - 28 - horizon + 1."""
    panel = series(spark, [i % 5 for i in range(91)])
    fold = fold_calendar(2024)[0]
    counts = {
        r.horizon: r.training_row_count
        for r in fo.eligibility_counts(fe.features_and_targets(panel), [fold]).collect()
    }
    assert counts == {1: 63, 7: 57, 14: 50, 28: 36}


def test_all_windows_share_one_exchange(spark):
    plan = fe.features_and_targets(series(spark, range(40)))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1
