"""Quantiles, grids, metrics, quality, models and requests on small fixtures."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.functions import grids, quantiles
from shelfline.operators import metrics as me
from shelfline.operators import quality as dq
from shelfline.operators import requests as rq
from shelfline.sources import handoff as ho
from shelfline.sources.panels import raw_panel, spread_over_calendar


def test_exact_percentiles_match_numpy(spark):
    rng = random.Random(5)
    data = [("a", rng.gauss(0, 5)) for _ in range(3000)]
    data += [("a", 1.25)] * 1500  # a third of the group is one value
    data += [("b", float(rng.randint(0, 3))) for _ in range(700)] + [("c", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in quantiles.describe(df, ["g"], "v").collect()}
    for g in "abc":
        values = np.array([v for k, v in data if k == g])
        for name, p in quantiles.DESCRIBE.items():
            assert math.isclose(got[g][name], np.quantile(values, p), abs_tol=1e-9)
        assert got[g]["count"] == len(values)
        if len(values) > 1:
            assert math.isclose(got[g]["std"], values.std(ddof=1), rel_tol=1e-9)
    assert got["c"]["std"] is None


def test_crossed_roster(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "SKU_ID string")
    b = spark.createDataFrame([("1",), ("2",), ("3",)], "Warehouse_ID string")
    out = grids.crossed(a, b)
    assert out.count() == 6 and out.distinct().count() == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_sparse_roster_lists_every_absent_pair(spark):
    rows = [("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("b", "3"), ("c", "3"), (None, "2")]
    out = dq.roster_gaps_by_key(spark.createDataFrame(rows, "SKU_ID string, Warehouse_ID string"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [("a", "2", 1, 2), ("a", "3", 1, 2), ("c", "1", 1, 2), ("c", "2", 1, 2), (None, "1", 1, 2), (None, "3", 1, 2)], key=repr
    )


def test_grid_difference_kinds(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (2,), (3,)], "k int")
    got = {r.k: r.problem for r in grids.grid_difference(left, right, ["k"]).collect()}
    assert got == {1: "missing", 2: "duplicate", 3: "unexpected"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    a = grids.fingerprint(df, ["id", "v"]).collect()
    b = grids.fingerprint(df.orderBy(F.desc("id")), ["id", "v"]).collect()
    c = grids.fingerprint(df.withColumn("v", F.col("v") + (F.col("id") == 5).cast("int")), ["id", "v"])
    assert a == b and a != c.collect()


def score(spark, rows):
    df = spark.createDataFrame(rows, "k int, prediction double, observed_target double")
    return me.score(df, ["k"]).collect()[0]


def test_metric_formulas_and_statuses(spark):
    s = score(spark, [(1, 3.0, 2.0), (1, 1.0, 4.0)])
    assert (s.wape, s.mae, s.bias) == (4 / 6, 2.0, -1.0)
    assert math.isclose(s.rmse, math.sqrt(5))
    s = score(spark, [(1, 3.0, 0.0)])
    assert s.metric_status == "undefined_zero_actual_total" and s.wape is None and s.mae == 3
    s = score(spark, [(1, float("nan"), 1.0), (1, 1.0, float("inf"))])
    assert s.failure_reason == "nonfinite_actual"
    s = score(spark, [(1, None, 1.0)])
    assert s.failure_reason == "nonfinite_prediction"
    s = score(spark, [(1, 1e300, -1e300)])
    assert s.failure_reason == "numeric_overflow" and s.mae is None


def test_fold_means_need_four_valid_folds(spark):
    rows = [(f, 0.5, 1.0, 2.0, 0.1, "valid", 3) for f in (1, 2, 3, 4)]
    schema = "fold_id int, wape double, mae double, rmse double, bias double, metric_status string, n_predictions long"
    df = spark.createDataFrame(rows, schema).withColumn("m", F.lit("x"))
    assert me.fold_means(df, ["m"]).collect()[0].mean_wape == 0.5
    short = me.fold_means(df.where("fold_id < 4"), ["m"]).collect()[0]
    assert short.metric_status == "unavailable" and short.mean_wape is None
    twice = me.fold_means(df.union(df.where("fold_id = 1")), ["m"]).collect()[0]
    assert twice.identity_defects == 1 and twice.mean_wape is None


def test_spread_over_calendar(spark):
    df = spark.createDataFrame(
        [("A", "W", date(2024, 1, 3), 5), ("A", "W", date(2024, 1, 5), 7)],
        "SKU_ID string, Warehouse_ID string, Date date, Units_Sold long",
    )
    out = spread_over_calendar(df, date(2024, 1, 1), date(2024, 1, 7)).orderBy("Date")
    assert [r.Units_Sold for r in out.collect()] == [0, 0, 5, 0, 7, 0, 0]


def test_clean_source_publishes_and_reopens(spark, sf_dir, tmp_path):
    path = str(tmp_path / "handoff")
    raw = raw_panel(spark, sf_dir).where("Date < '1997-02-15'")
    ho.sink_validated(raw, path)
    back = ho.scan_validated(spark, path)
    assert back.count() == raw.count()
    scan = ho.scan_projection(spark, path, ["SKU_ID", "Units_Sold"], date(1997, 2, 1), date(1997, 2, 3))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Date)" in plan and "Unit_Cost" not in plan
    with pytest.raises(Exception):
        ho.sink_validated(raw, path)  # exclusive create


def test_defective_source_is_refused(spark, sf_dir, tmp_path):
    raw = raw_panel(spark, sf_dir).where("Date < '1997-01-10'")
    bad = raw.withColumn(
        "Units_Sold", F.when(F.col("Date") == "1997-01-05", "-1").otherwise(F.col("Units_Sold"))
    )
    with pytest.raises(dq.SourceDefects, match="Units_Sold_negative"):
        ho.sink_validated(bad, str(tmp_path / "refused"))


def test_schema_check(spark, sf_dir):
    raw = raw_panel(spark, sf_dir)
    assert dq.check_schema(raw) == []
    assert dq.check_schema(raw.drop("Region")) == ["column_set_differs"]
    assert dq.check_schema(raw.where("1 = 0")) == ["empty_scope"]


def requests(spark, **change):
    days = [(date(2024, 1, 1) + timedelta(days=i)).isoformat() for i in range(30)]
    row = dict(
        SKU_ID="A", Warehouse_ID="W", forecast_origin="2024-01-30", horizon=7,
        input_kind="supplied_history", history=[(d, float(i)) for i, d in enumerate(days)],
    )
    row.update(change)
    return spark.createDataFrame([tuple(row.values())], rq.REQUEST_SCHEMA)


HISTORY = [((date(2024, 1, 1) + timedelta(days=i)).isoformat(), float(i)) for i in range(30)]


@pytest.mark.parametrize(
    "change, code",
    [
        ({}, None),
        (dict(horizon=5), "unsupported_horizon"),
        (dict(SKU_ID="Z"), "unknown_sku"),
        (dict(Warehouse_ID="Z"), "unknown_warehouse"),
        (dict(forecast_origin="2024-01-10"), "invalid_origin"),
        (dict(history=HISTORY[:20]), "insufficient_history"),
        (dict(history=[*HISTORY[:5], *HISTORY[6:]]), "invalid_history"),
        (dict(history=[(HISTORY[0][0], 0.5), *HISTORY[1:]]), "invalid_history"),
        (dict(history=[*HISTORY[:-1], (HISTORY[-1][0], None)]), "incomplete_history"),
        (dict(forecast_origin="2024-01-29"), "future_history"),
        (dict(forecast_origin="2024-01-31"), "incomplete_history"),
    ],
)
def test_request_rejections(spark, change, code):
    got = rq.classify(requests(spark, **change), ["A"], ["W"], date(2024, 1, 20)).collect()[0]
    assert got.rejection == code


def test_request_hash_is_canonical_json(spark):
    import hashlib
    import json

    req = rq.classify(requests(spark), ["A"], ["W"], date(2024, 1, 20))
    got = req.select(rq.input_hash(req).alias("h")).collect()[0].h
    document = {
        "SKU_ID": "A", "Warehouse_ID": "W", "forecast_origin": "2024-01-30", "horizon": 7,
        "input_kind": "supplied_history",
        "history": [{"Date": d, "Units_Sold": int(u)} for d, u in HISTORY],
    }
    text = json.dumps(document, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(text.encode()).hexdigest()


def test_ridge_reproduces_the_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler

    from shelfline.operators.models import estimator

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([2.0, -1.0, 0.5]) + 4 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, target double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = estimator("ridge", "fixed", float(y.std()), len(y)).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)


def test_representation_ids_carry_the_population(spark):
    from shelfline.fixed import FEATURES
    from shelfline.operators.models import representation_catalogue

    rows = [(1, 7, "A", "W", date(2024, 2, i), 1.0) for i in (1, 2)]
    df = spark.createDataFrame(
        rows,
        "fold_id int, horizon int, SKU_ID string, Warehouse_ID string, Date date, target double",
    )
    got = representation_catalogue(df, ("ridge", "xgboost")).collect()
    assert {r.model for r in got} == {"ridge", "xgboost"}
    assert all(r.representation_id.startswith(f"validation-{r.model}-h7-f1-") for r in got)
    assert all(r.physical_feature_count == 2 + len(FEATURES) for r in got)
    other = representation_catalogue(df.limit(1), ("ridge",)).collect()[0]
    assert other.representation_id not in {r.representation_id for r in got}
