"""Fitted encoder state and model matrices.

Vocabularies are relations (a level and its index), so a large SKU dimension is
never held in one row; the ML pipeline variant uses the same alphabetical order.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, SERIES

GROUP = ["fold_id", "horizon"]


def vocabularies(training: DataFrame) -> DataFrame:
    """Sorted distinct levels per fold, horizon and categorical column.

    Levels are distinct dimension values; the numbering window holds one
    dimension's levels.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in SERIES]
    )
    levels = (
        training.select(*GROUP, F.explode(entries).alias("e"))
        .select(*GROUP, "e.*")
        .distinct()
    )
    order = Window.partitionBy(*GROUP, "column").orderBy("level")
    return levels.withColumn("index", F.row_number().over(order) - 1)


def scaler_state(training: DataFrame) -> DataFrame:
    """Means and population standard deviations (0 becomes 1), long form."""
    wide = training.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("training_rows"),
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"m_{c}").alias("mean"),
                # spreads at rounding-noise level belong to constant columns
                F.when(F.col(f"s_{c}") < 1e-12, 1.0).otherwise(F.col(f"s_{c}")).alias("scale"),
            )
            for c in FEATURES
        ]
    )
    return wide.select(*GROUP, "training_rows", F.explode(entries).alias("e")).select(
        *GROUP, "training_rows", "e.*"
    )


def encode_long(rows: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """Hot indicator positions of each row; an unseen level fails.

    ``keys`` identify a row and include the fold and horizon of its encoder.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in SERIES]
    )
    long = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    unseen = F.raise_error(F.concat_ws(" ", F.lit("unseen level"), "column", "level")).cast("int")
    found = long.join(vocabulary, [*GROUP, "column", "level"], "left")
    return found.withColumn("index", F.coalesce("index", unseen))


def encode_wide(rows: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Full one-hot columns (no dropped level) followed by the numerics; an unseen level fails."""
    known = F.lit(True)
    for c, values in levels.items():
        known = known & F.coalesce(F.col(c).isin(values), F.lit(False))
    rows = rows.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit("unseen level")).cast("boolean")))
    hot = [
        (F.col(c) == level).cast("int").alias(f"{c}={level}")
        for c, values in levels.items()
        for level in values
    ]
    return rows.select(*[c for c in rows.columns if c not in FEATURES], *hot, *FEATURES)


def standardise(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Numerics as (x - mean) / scale with the state of their fold and horizon."""
    wide = (
        state.groupBy(*GROUP)
        .pivot("feature", FEATURES)
        .agg(F.first("mean").alias("m"), F.first("scale").alias("s"))
    )
    joined = rows.join(F.broadcast(wide), GROUP)  # one row per fold and horizon
    return joined.select(
        *[c for c in rows.columns if c not in FEATURES],
        *[((F.col(c) - F.col(f"`{c}_m`")) / F.col(f"`{c}_s`")).alias(c) for c in FEATURES],
    )


def fit_encoder(training: DataFrame) -> PipelineModel:
    """ML encoder of one fold and horizon, shared by all models.

    Levels are indexed alphabetically, every level gets a column and an unseen
    level fails the transform.
    """
    stages = [
        StringIndexer(
            inputCols=list(SERIES),
            outputCols=["_sku_i", "_wh_i"],
            stringOrderType="alphabetAsc",
            handleInvalid="error",
        ),
        OneHotEncoder(
            inputCols=["_sku_i", "_wh_i"], outputCols=["_sku_v", "_wh_v"], dropLast=False
        ),
        VectorAssembler(inputCols=["_sku_v", "_wh_v", *FEATURES], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(training)


def encode(rows: DataFrame, encoder: PipelineModel) -> DataFrame:
    made = ["_sku_i", "_wh_i", "_sku_v", "_wh_v"]
    return encoder.transform(rows).drop(*made)
