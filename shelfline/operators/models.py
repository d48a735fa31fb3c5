"""Model fitting as Spark jobs over stored training tables.

Tree models (a forest and three boosting families) of a whole plan are one grouped job
over bounded blocks of rows (``ensembles``); ridge of a whole plan is one set of sums
(``ridge``).  ``fit`` gives a single ridge model as a Spark ML pipeline, for serving and
replay.  Predictions are written to the shared folder and read back as one table,
so nothing is collected and a lost executor costs only running tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, FOREST_TREES, PRIMARY_MODELS, RIDGE_ALPHA, SEED, SERIES
from shelfline.operators.encode import encode, fit_encoder, scaler_state, standardise, vocabularies
from shelfline.operators.ensembles import fit_trees, score_trees
from shelfline.operators.ridge import fit_ridge, score_ridge
from shelfline.session import scratch_path, shared_dir, stored

#: Solver of ridge, the same at every size.  "normal" is exact and takes up to 4,096
#: columns (Spark raises beyond them); "l-bfgs" is iterative and takes any number.
SOLVER = "normal"


@dataclass(frozen=True)
class Fitted:
    """A fitted candidate: encoder, regressor and its scaler state (ridge)."""

    model: str
    configuration_id: str
    encoder: PipelineModel
    regressor: object
    state: DataFrame | None

    def predict(self, rows: DataFrame, output: str = "prediction") -> DataFrame:
        scaled = standardise(rows, self.state) if self.state is not None else rows
        encoded = encode(scaled, self.encoder)
        return self.regressor.transform(encoded).drop("features").withColumnRenamed(
            "prediction", output
        )


def estimator(model: str, configuration_id: str, label_spread: float, rows: int, solver: str = SOLVER) -> LinearRegression:
    if model != "ridge":
        raise ValueError(f"{model} is not a linear model")
    # Spark rescales the label; this penalty reproduces alpha on raw labels
    return LinearRegression(
        labelCol="target",
        elasticNetParam=0.0,
        standardization=False,
        solver=solver,
        regParam=RIDGE_ALPHA * label_spread / rows,
    )


@dataclass(frozen=True)
class Prepared:
    """The encoded rows of one fold and horizon, and what fits on them need."""

    encoder: PipelineModel
    state: DataFrame | None
    table: DataFrame
    spread: float
    rows: int


def prepare(training: DataFrame, scaled: bool, keep: bool = False) -> Prepared:
    """Encode (for ridge also scale) the rows of one fold and horizon; ``keep`` stores them."""
    encoder = fit_encoder(training)
    state = scaler_state(training) if scaled else None
    table = encode(standardise(training, state) if scaled else training, encoder).select("features", "target")
    facts = training.agg(
        F.stddev_pop("target").alias("spread"), F.count(F.lit(1)).alias("n")
    ).first()
    return Prepared(encoder, state, stored(table, "encoded") if keep else table, facts["spread"] or 1.0, facts["n"])


def learn(prepared: Prepared, model: str, configuration_id: str, solver: str = SOLVER) -> Fitted:
    """Fit one linear candidate on prepared rows."""
    spark = prepared.table.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    learner = estimator(model, configuration_id, prepared.spread, prepared.rows, solver)
    return Fitted(model, configuration_id, prepared.encoder, learner.fit(prepared.table), prepared.state)


def fit(training: DataFrame, model: str, configuration_id: str, solver: str = SOLVER) -> Fitted:
    """Fit one linear candidate on the rows of one fold and horizon.

    ``training`` should be a stored table: fitting scans it many times.
    """
    return learn(prepare(training, model == "ridge"), model, configuration_id, solver)


def refuse_unseen_levels(training: DataFrame, origins: DataFrame) -> None:
    """Raises if an origin has a category level that its fold's training rows do not have."""
    known = vocabularies(training).select("fold_id", "column", "level").distinct()
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in SERIES])
    asked = origins.select("fold_id", F.explode(entries).alias("e")).select("fold_id", "e.*").distinct()
    first = asked.join(known, ["fold_id", "column", "level"], "left_anti").first()
    if first is not None:
        raise ValueError(f"unseen level {first['column']} {first['level']} in fold {first['fold_id']}")


def fit_candidates(
    training: DataFrame,
    origins: DataFrame,
    candidates: Iterable[tuple[str, int, str, int]],
    forest_trees: int = FOREST_TREES,
) -> DataFrame:
    """Fit (model, horizon, configuration, fold) candidates and score origins.

    Returns fold_id, series, horizon, model, configuration_id, prediction.  A
    candidate that yields a missing or nonfinite prediction raises.
    """
    spark = training.sparkSession
    path = scratch_path(spark, "candidate-predictions")
    candidates = list(candidates)
    names = ["fold_id", *SERIES, "horizon", "model", "configuration_id", "prediction"]
    trees = [c for c in candidates if c[0] != "ridge"]
    linear = [c for c in candidates if c[0] == "ridge"]
    refuse_unseen_levels(training, origins)
    if trees:
        models = fit_trees(training, trees, forest_trees)
        score_trees(models, origins).select(*names).write.mode("errorifexists").parquet(f"{path}/trees")

    if linear:
        asked = F.struct("fold_id", "horizon").isin([F.struct(F.lit(f), F.lit(h)) for _, h, _, f in linear])
        scored = score_ridge(fit_ridge(training.where(asked)), origins)
        scored.withColumns({"model": F.lit("ridge"), "configuration_id": F.lit(linear[0][2])}).select(*names).write.mode("errorifexists").parquet(f"{path}/ridge")
    out = spark.read.option("recursiveFileLookup", True).parquet(path)
    bad = F.col("prediction").isNull() | F.isnan("prediction") | (
        F.abs("prediction") == float("inf")
    )
    if not out.where(bad).isEmpty():
        raise ValueError("a candidate produced a nonfinite prediction")
    return out


def representation_catalogue(training: DataFrame, models=("ridge", "random_forest", *PRIMARY_MODELS)) -> DataFrame:
    """Per model, horizon and fold: row count, vocabulary sizes, population token."""
    from shelfline.functions.expr import explode_values
    from shelfline.operators.forecast import role_column

    token = F.xxhash64(*SERIES, "Date", "target").cast("decimal(38,0)")
    facts = training.groupBy("fold_id", "horizon").agg(
        F.count(F.lit(1)).alias("training_row_count"),
        F.count_distinct("SKU_ID").alias("sku_levels"),
        F.count_distinct("Warehouse_ID").alias("warehouse_levels"),
        F.sum(token).cast("string").alias("population_token"),
    )
    rows = facts.select(
        "*", explode_values([(m,) for m in models], ["model"]).alias("_m")
    ).select(*facts.columns, "_m.model")
    return rows.select(
        F.concat(
            F.lit("validation-"), "model", F.lit("-h"), F.col("horizon").cast("string"),
            F.lit("-f"), F.col("fold_id").cast("string"), F.lit("-"), "population_token",
        ).alias("representation_id"),
        "model",
        role_column().alias("evidence_role"),
        "horizon",
        "fold_id",
        "training_row_count",
        "sku_levels",
        "warehouse_levels",
        (F.col("sku_levels") + F.col("warehouse_levels") + len(FEATURES)).alias(
            "physical_feature_count"
        ),
        F.array(*[F.lit(f) for f in FEATURES]).alias("numerical_feature_names"),
    )


def replay_differences(model: PipelineModel, inputs: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on which a reloaded model disagrees with its stored predictions."""
    again = model.transform(inputs).select(*keys, F.col("prediction").alias("_again"))
    return stored.select(*keys, "prediction").join(again, keys, "full_outer").where(
        ~F.col("prediction").eqNullSafe(F.col("_again"))
    )
