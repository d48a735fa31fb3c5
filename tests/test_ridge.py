import numpy as np
import pytest

from shelfline.fixed import FEATURES, SERIES
from shelfline.operators import models as mo
from shelfline.operators import ridge

KINDS = "fold_id int, horizon int, SKU_ID string, Warehouse_ID string, Date date, " + ", ".join(f"{f} double" for f in FEATURES) + ", target double"


def population(rng, fold, horizon, rows, skus, warehouses):
    out = []
    for i in range(rows):
        x = rng.standard_normal(len(FEATURES)) * np.linspace(1, 50, len(FEATURES)) + 7
        sku, wh = f"S{rng.integers(skus)}", f"W={rng.integers(warehouses)}"
        out.append((fold, horizon, sku, wh, None, *map(float, x), float(x[0] - x[3] / 9 + hash((sku, wh)) % 5 + rng.standard_normal())))
    return out


def dense(rows, asked, alpha=1.0):
    """Predictions by the closed form with an indicator column for every level."""
    levels = [sorted({r[2 + i] for r in rows}) for i in range(2)]
    numeric = np.array([r[5:-1] for r in rows])
    mean, spread = numeric.mean(0), numeric.std(0)
    spread[spread < 1e-12] = 1

    def matrix(some):
        hot = [[float(r[2 + i] == v) for i in range(2) for v in levels[i]] for r in some]
        return np.hstack([np.array(hot), (np.array([r[5 : 5 + len(FEATURES)] for r in some]) - mean) / spread])

    x, y = matrix(rows), np.array([r[-1] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return (matrix(asked) - x.mean(0)) @ w + y.mean()


def test_equals_the_closed_form_in_every_population(spark):
    rng = np.random.default_rng(8)
    tables = {(f, h): population(rng, f, h, n, s, w) for f, h, n, s, w in ((1, 1, 200, 7, 3), (1, 7, 150, 60, 2), (2, 7, 90, 1, 1))}
    training = spark.createDataFrame([r for rows in tables.values() for r in rows], KINDS)
    origins = {}
    for (fold, horizon), rows in tables.items():
        origins.setdefault(fold, []).extend(r for r in rows if all(any(r[2:4] == (q[2], q[3]) or (r[2] in {t[2] for t in tables[fold, k]} and r[3] in {t[3] for t in tables[fold, k]}) for q in tables[fold, k]) for f, k in tables if f == fold))
    asked = {f: list({r[2:4]: r for r in rows}.values()) for f, rows in origins.items()}
    points = spark.createDataFrame([r[:-1] + (0.0,) for rows in asked.values() for r in rows], KINDS).drop("horizon", "target", "Date")
    found = {(r.fold_id, r.horizon, r.SKU_ID, r.Warehouse_ID): r.prediction for r in ridge.score_ridge(ridge.fit_ridge(training), points).collect()}
    assert len(found) == sum(len(asked[f]) for f, _ in tables)
    for (fold, horizon), rows in tables.items():
        for r, want in zip(asked[fold], dense(rows, asked[fold]), strict=True):
            assert found[fold, horizon, r[2], r[3]] == pytest.approx(want, abs=1e-7)


def test_many_skus_equal_the_pipeline(spark):
    """More indicator columns than rows of the dense block; the Spark ML model is the other path."""
    rng = np.random.default_rng(9)
    rows = population(rng, 1, 7, 400, 300, 4)
    training = mo.stored(spark.createDataFrame(rows, KINDS), "t")
    origins = training.select("fold_id", *SERIES, *FEATURES).limit(20)
    origins = mo.stored(origins.dropDuplicates(SERIES), "o")
    ours = {(r.SKU_ID, r.Warehouse_ID): r.prediction for r in mo.fit_candidates(training, origins, [("ridge", 7, "fixed", 1)]).collect()}
    from pyspark.sql import functions as F

    theirs = mo.fit(training, "ridge", "fixed").predict(origins.withColumn("horizon", F.lit(7)))
    for r in theirs.collect():
        assert ours[r.SKU_ID, r.Warehouse_ID] == pytest.approx(r.prediction, abs=1e-4)
