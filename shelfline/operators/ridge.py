"""Ridge regression of many populations at once, by block elimination.

Columns are an indicator for every SKU and every warehouse, and the standardised
numerics; all have the penalty, the intercept has none.  Of the normal equations

    [D  B] [u]   [r]        D = rows of each SKU + penalty (diagonal)
    [B' A] [z] = [s]        z = intercept, warehouses, numerics

the SKUs are eliminated exactly: (A - B' D^-1 B) z = s - B' D^-1 r is a small dense
system, however many SKUs there are, and a SKU's coefficient is (r - B z) / D.  All
sums come from one aggregate by (population, SKU, warehouse), whose rows are the
series; what reaches the driver is a system of 13 + warehouses unknowns for each fold
and horizon.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, RIDGE_ALPHA, SERIES
from shelfline.operators.encode import GROUP, scaler_state, standardise, vocabularies
from shelfline.session import stored

SKU, WAREHOUSE = SERIES


@dataclass(frozen=True)
class Ridge:
    """Scaler state, coefficients of the dense block (long form) and of every SKU."""

    state: DataFrame
    dense: DataFrame
    skus: DataFrame


def _series_sums(training: DataFrame, state: DataFrame) -> DataFrame:
    """Counts and sums of x, y, x y and x x' of every series of every population."""
    rows = standardise(training.select(*GROUP, *SERIES, *FEATURES, "target"), state)
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    summed = rows.groupBy(*GROUP, *SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("y"),
        *[F.sum(c).alias(f"x_{c}") for c in FEATURES], *[F.sum(F.col(c) * F.col("target")).alias(f"xy_{c}") for c in FEATURES],
        *[F.sum(F.col(a) * F.col(b)).alias(f"xx_{a}_{b}") for a, b in pairs],
    )
    return summed.select(
        *GROUP, *SERIES, "n", "y", F.array(*[f"x_{c}" for c in FEATURES]).alias("x"), F.array(*[f"xy_{c}" for c in FEATURES]).alias("xy"),
        F.array(*[f"xx_{a}_{b}" for a, b in pairs]).alias("xx"),
    )


def _systems(alpha: float, warehouses: dict[tuple[int, int], int]):
    """Shares of the reduced systems: for each population the upper rows of (A - B'B/D | s - B'r/D)."""
    k = len(FEATURES)
    upper = np.triu_indices(k)

    def share(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["fold_id"], row["horizon"])
                width = 1 + warehouses[key]
                system = total.setdefault(key, np.zeros((width + k, width + k + 1)))
                b, r, count = np.zeros(width + k), 0.0, 0
                for one in row["members"]:
                    at, x, xx = 1 + one["index"], np.array(one["x"]), np.zeros((k, k))
                    xx[upper] = one["xx"]
                    system[width:, width:-1] += xx + np.triu(xx, 1).T
                    for i in (0, at):
                        system[i, width:-1] += x
                        system[width:, i] += x
                        system[i, i] += one["n"]
                        system[i, -1] += one["y"]
                    system[0, at] += one["n"]
                    system[at, 0] += one["n"]
                    system[width:, -1] += one["xy"]
                    b[0] += one["n"]
                    b[at] += one["n"]
                    b[width:] += x
                    r, count = r + one["y"], count + one["n"]
                system -= np.outer(b, np.append(b, r)) / (count + alpha)
        for (fold, horizon), system in total.items():
            n = system.size
            yield pa.RecordBatch.from_pydict(
                {"fold_id": np.full(n, fold, np.int32), "horizon": np.full(n, horizon, np.int32), "entry": np.arange(n), "value": system.ravel()}
            )

    return share


def fit_ridge(training: DataFrame, alpha: float = RIDGE_ALPHA) -> Ridge:
    """Ridge of every fold and horizon of the training rows."""
    spark = training.sparkSession
    state = stored(scaler_state(training), "scaler")
    places = stored(vocabularies(training).where(F.col("column") == WAREHOUSE), "warehouses")
    known = {}
    for r in places.orderBy(*GROUP, "index").collect():  # the warehouses of the dense block
        known.setdefault((r["fold_id"], r["horizon"]), []).append(r["level"])
    widths = {key: len(levels) for key, levels in known.items()}
    series = _series_sums(training, state).join(
        places.select(*GROUP, F.col("level").alias(WAREHOUSE), "index"), [*GROUP, WAREHOUSE]
    )
    members = F.array_sort(F.collect_list(F.struct("index", "n", "y", "x", "xy", "xx")))
    skus = stored(series.groupBy(*GROUP, SKU).agg(members.alias("members")), "ridge-sums")
    shares = skus.mapInArrow(_systems(alpha, widths), "fold_id int, horizon int, entry long, value double")
    systems: dict[tuple[int, int], np.ndarray] = {}
    for r in shares.groupBy(*GROUP, "entry").agg(F.sum("value").alias("value")).collect():
        key = (r["fold_id"], r["horizon"])
        q = 1 + widths[key] + len(FEATURES)
        systems.setdefault(key, np.zeros(q * (q + 1)))[r["entry"]] = r["value"]
    dense = []
    for key, flat in systems.items():
        q = 1 + widths[key] + len(FEATURES)
        system = flat.reshape(q, q + 1)
        matrix = system[:, :-1] + alpha * np.diag([0.0] + [1.0] * (q - 1))
        names = ["intercept", *[f"{WAREHOUSE}={w}" for w in known[key]], *FEATURES]
        dense += [(*key, name, float(v)) for name, v in zip(names, np.linalg.solve(matrix, system[:, -1]), strict=True)]
    solved = spark.createDataFrame(dense, "fold_id int, horizon int, name string, coefficient double")
    wide = _wide(solved)
    offered = F.aggregate("members", F.lit(0.0), lambda total, m: total + m["y"] - m["n"] * (F.col("intercept") + F.element_at("places", m["index"] + 1))
                          - F.aggregate(F.zip_with(m["x"], F.col("slopes"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    count = F.aggregate("members", F.lit(0).cast("long"), lambda total, m: total + m["n"])
    own = skus.join(F.broadcast(wide), GROUP).select(*GROUP, SKU, (offered / (count + alpha)).alias("coefficient"))
    return Ridge(state, solved, stored(own, "ridge-skus"))


def _wide(dense: DataFrame) -> DataFrame:
    """One row for each population: intercept, slopes in feature order, warehouses by level."""
    at = F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("name"))
    slope = F.when(at > 0, F.struct(at.alias("at"), "coefficient"))
    level = F.substring(F.col("name"), len(WAREHOUSE) + 2, 1 << 30)
    place = F.when(F.col("name").startswith(f"{WAREHOUSE}="), F.struct(level.alias("level"), "coefficient"))
    return dense.groupBy(*GROUP).agg(
        F.max(F.when(F.col("name") == "intercept", F.col("coefficient"))).alias("intercept"),
        F.array_sort(F.collect_list(place)).alias("_places"), F.array_sort(F.collect_list(slope)).alias("_slopes"),
    ).select(
        *GROUP, "intercept", F.transform("_slopes", lambda s: s["coefficient"]).alias("slopes"),
        F.transform("_places", lambda p: p["coefficient"]).alias("places"), F.map_from_entries("_places").alias("by_level"),
    )


def score_ridge(model: Ridge, origins: DataFrame) -> DataFrame:
    """fold_id, series, horizon and prediction of every origin at every horizon of its fold's models."""
    wide = _wide(model.dense)
    horizons = model.dense.select(*GROUP).distinct()
    points = origins.select("fold_id", *SERIES, *FEATURES).join(F.broadcast(horizons), "fold_id")
    scaled = standardise(points, model.state).join(F.broadcast(wide), GROUP)
    with_sku = scaled.join(model.skus.withColumnRenamed("coefficient", "_u"), [*GROUP, SKU], "left")
    terms = F.aggregate(F.zip_with(F.array(*FEATURES), F.col("slopes"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    value = F.col("intercept") + F.col("_u") + F.element_at("by_level", F.col(WAREHOUSE)) + terms
    return with_sku.select("fold_id", *SERIES, "horizon", value.alias("prediction"))
