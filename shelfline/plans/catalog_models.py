"""Encoder, model and request-scoring queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, PRIMARY_MODELS, PRODUCERS, SERIES
from shelfline.functions.expr import finite
from shelfline.operators import encode as en
from shelfline.operators import export as ex
from shelfline.operators import features as fe
from shelfline.operators import folds as fo
from shelfline.operators import forecast as fc
from shelfline.operators import metrics as me
from shelfline.operators import models as mo
from shelfline.operators import reconcile as rc
from shelfline.operators import requests as rq
from shelfline.plans.backtest_fixture import FOLDS, RUN
from shelfline.plans.catalog_features import prepared_sql
from shelfline.plans.catalog_profile import r
from shelfline.plans.oracle_base import DEMAND, PANEL, with_
from shelfline.plans.registry import query
from shelfline.session import published, scratch_path, stored
from shelfline.sources.panels import FULL_END, FULL_START, published_demand, rank_tables
from shelfline.streaming import requests as stream

TRAIN_SQL = (
    with_(*prepared_sql(DEMAND, "demand"))
    + ", train AS (SELECT * FROM tagged WHERE ready AND inside AND target IS NOT NULL AND fold_id <= 4)"
)


def _training(spark, sf_dir, folds=FOLDS[:4]):
    return fo.training_rows(fe.features_and_targets(published_demand(spark, sf_dir)), folds)


@query(
    "fit_encoder_vocabulary",
    "M1 M3",
    TRAIN_SQL
    + """, lv AS (SELECT DISTINCT fold_id, horizon, 'SKU_ID' AS c, SKU_ID AS level FROM train UNION ALL SELECT DISTINCT fold_id, horizon, 'Warehouse_ID', Warehouse_ID FROM train)
SELECT fold_id, horizon, c AS "column", level, row_number() OVER (PARTITION BY fold_id, horizon, c ORDER BY level) - 1 AS index FROM lv""",
)
def fit_encoder_vocabulary(spark, sf_dir):
    return en.vocabularies(_training(spark, sf_dir))


@query(
    "fit_encoder_scaler",
    "M1",
    TRAIN_SQL
    + " UNION ALL ".join(
        f"SELECT fold_id, horizon, count(*) AS training_rows, '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) < 1e-12 THEN 1 ELSE stddev_pop({f}) END, 6) AS scale FROM train GROUP BY 1, 2"
        for f in FEATURES
    ).replace("SELECT", "\nSELECT", 1),
)
def fit_encoder_scaler(spark, sf_dir):
    return r(en.scaler_state(_training(spark, sf_dir)), "mean", "scale")


@query(
    "encode",
    "M2 M3",
    TRAIN_SQL
    + """, lv AS (SELECT DISTINCT fold_id, horizon, 'SKU_ID' AS c, SKU_ID AS level FROM train UNION ALL SELECT DISTINCT fold_id, horizon, 'Warehouse_ID', Warehouse_ID FROM train),
ix AS (SELECT *, row_number() OVER (PARTITION BY fold_id, horizon, c ORDER BY level) - 1 AS index FROM lv)
SELECT t.fold_id, t.horizon, t.SKU_ID, t.Warehouse_ID, t.Date, c AS "column", level, index FROM train t JOIN ix i ON i.fold_id = t.fold_id AND i.horizon = t.horizon
AND i.level = CASE i.c WHEN 'SKU_ID' THEN t.SKU_ID ELSE t.Warehouse_ID END""",
)
def encode(spark, sf_dir):
    training = _training(spark, sf_dir)
    return en.encode_long(
        training, en.vocabularies(training), ["fold_id", "horizon", *SERIES, "Date"]
    )


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "encode_wide",
    "M2",
    TRAIN_SQL
    + "SELECT fold_id, horizon, SKU_ID, Warehouse_ID, Date, target, "
    + ", ".join(f"CAST(SKU_ID = '{t}' AS INTEGER) AS \"SKU_ID={t}\"" for t in TYPES)
    + ", "
    + ", ".join(f"CAST(Warehouse_ID = '{t}' AS INTEGER) AS \"Warehouse_ID={t}\"" for t in REGIONS)
    + ", "
    + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)
    + " FROM train",
)
def encode_wide(spark, sf_dir):
    rows = en.encode_wide(
        _training(spark, sf_dir).drop("training_end"),
        {"SKU_ID": TYPES, "Warehouse_ID": REGIONS},
    )
    return rows.select(
        *[F.round(c, 6).alias(c) if c in FEATURES else F.col(f"`{c}`") for c in rows.columns]
    )


@query(
    "standardise",
    "M2",
    TRAIN_SQL
    + ", st AS (SELECT fold_id, horizon, "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    + " FROM train GROUP BY 1, 2) SELECT t.fold_id, t.horizon, SKU_ID, Warehouse_ID, Date, "
    + ", ".join(f"round(({f} - m_{f}) / CASE WHEN s_{f} < 1e-12 THEN 1 ELSE s_{f} END, 5) AS {f}" for f in FEATURES)
    + " FROM train t JOIN st USING (fold_id, horizon)",
)
def standardise(spark, sf_dir):
    training = _training(spark, sf_dir)
    out = en.standardise(training, en.scaler_state(training))
    return out.select(
        "fold_id", "horizon", *SERIES, "Date", *[F.round(f, 5).alias(f) for f in FEATURES]
    )


@query(
    "representation_catalogue",
    "M20",
    TRAIN_SQL
    + """, facts AS (SELECT fold_id, horizon, count(*) AS training_row_count, count(DISTINCT SKU_ID) AS sku_levels, count(DISTINCT Warehouse_ID) AS warehouse_levels FROM train GROUP BY 1, 2)
SELECT model, evidence_role, horizon, fold_id, training_row_count, sku_levels, warehouse_levels, sku_levels + warehouse_levels + 12 AS physical_feature_count FROM facts,
(VALUES ('ridge', 'supportive'), ('random_forest', 'supportive'), ('xgboost', 'primary'), ('lightgbm', 'primary'), ('catboost', 'primary')) AS m(model, evidence_role)""",
)
def representation_catalogue(spark, sf_dir):
    # the id carries a hash token that SQL cannot reproduce; tests cover it
    return mo.representation_catalogue(_training(spark, sf_dir)).drop(
        "representation_id", "numerical_feature_names"
    )


# --- fitted models ----------------------------------------------------------


def _stored_inputs(spark, sf_dir, folds):
    demand = published_demand(spark, sf_dir)
    training = stored(_training(spark, sf_dir, folds), "training")
    origins = stored(fe.origin_features(demand, folds), "origins")
    return demand, training, origins


def _fitted_scores(spark, sf_dir, candidates, folds, **options):
    demand, training, origins = _stored_inputs(spark, sf_dir, folds)
    predictions = mo.fit_candidates(training, origins, candidates, **options)
    observed = fo.observed_targets(fe.build_targets(demand, FULL_START, FULL_END), folds)
    rows = fc.forecast_rows(predictions, observed, FOLDS, RUN)
    return me.score(rows, [*me.SUMMARY_KEYS, "fold_id"])


def _planned(*models):
    return [candidate[1:] for candidate in fc.candidate_plan(models)]


@query("ridge", "M8 M11")
def ridge(spark, sf_dir):
    """Ridge over the four folds and all horizons, scored at each origin."""
    plan = [("ridge", h, "fixed", f) for h in (1, 7, 14, 28) for f in (1, 2, 3, 4)]
    return _fitted_scores(spark, sf_dir, plan, FOLDS[:4])


@query("random_forest", "M9 M11")
def random_forest(spark, sf_dir):
    """Forests of the library's 300 trees over the four folds and all horizons."""
    return _fitted_scores(spark, sf_dir, _planned("random_forest"), FOLDS[:4])


@query("boosted_trees", "M10 M11")
def boosted_trees(spark, sf_dir):
    """The whole grid of the three boosting models over the four folds and all horizons."""
    return _fitted_scores(spark, sf_dir, _planned(*PRIMARY_MODELS), FOLDS[:4])


def sealed_final_predictions(spark, sf_dir):
    """Final predictions of ridge and the designated producers, from history alone and stored once."""
    folds = FOLDS[4:]

    def build():
        history = published_demand(spark, sf_dir).where(F.col("Date") <= F.lit(folds[0].end))
        training = stored(fo.training_rows(fe.features_and_targets(history), folds), "training")
        origins = stored(fe.origin_features(history, folds), "origins")
        plan = [("ridge", h, "fixed", 5) for h in (1, 7, 14, 28)] + [(m, h, c, 5) for h, m, c in PRODUCERS]
        return mo.fit_candidates(training, origins, plan)

    sources = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "part", "supplier", "nation", "region")]
    return published(spark, f"final-predictions:{sf_dir}", sources, build)


@query("final_refit", "M12 S18")
def final_refit(spark, sf_dir):
    """Refit ridge and the designated producers on all history, store predictions, only then read outcomes."""
    folds = FOLDS[4:]
    sealed = sealed_final_predictions(spark, sf_dir)
    outcomes = published_demand(spark, sf_dir).where(F.col("Date") > F.lit(folds[0].end))
    observed = fo.observed_targets(
        fe.build_targets(outcomes, folds[0].end, folds[0].outcome_end), folds
    )
    rows = fc.forecast_rows(sealed, observed, FOLDS, RUN, "final_evaluation")
    return me.score(rows, [*me.SUMMARY_KEYS, "fold_id"])


def learned_export(spark, sf_dir):
    """The export of the designated producers as fitted, not of stand-ins."""
    return ex.build_export(fc.forecast_rows(sealed_final_predictions(spark, sf_dir), None, FOLDS, RUN, "final_evaluation"))


@query(
    "export_learned",
    "M17 M12 S18",
    with_(DEMAND)
    + """SELECT SKU_ID, Warehouse_ID, DATE '1997-12-02' AS forecast_origin, horizon, DATE '1997-12-03' AS target_start_date,
DATE '1997-12-02' + horizon AS target_end_date, model, configuration_id, 'bench-run' AS run_id, 'final_evaluation' AS evaluation_stage,
'primary' AS evidence_role, CASE WHEN horizon = 1 THEN 'next_day' ELSE 'cumulative_window' END AS forecast_type, true AS usable
FROM (SELECT DISTINCT SKU_ID, Warehouse_ID FROM demand WHERE Date <= DATE '1997-12-02') AS roster,
(VALUES (1, 'lightgbm', 'GBM018'), (7, 'lightgbm', 'GBM011'), (14, 'xgboost', 'GBM022'), (28, 'xgboost', 'GBM003')) AS p(horizon, model, configuration_id)""",
)
def export_learned(spark, sf_dir):
    """The whole grid of the learned export; the quantities are the models' and only checked to be finite."""
    export = learned_export(spark, sf_dir)
    kept = ["forecast_origin", "horizon", "target_start_date", "target_end_date", "model", "configuration_id", "run_id", "evaluation_stage", "evidence_role", "forecast_type"]
    return export.select(*SERIES, *kept, finite("prediction").alias("usable"))


@query("exposure_learned", "M17 I13 J5")
def exposure_learned(spark, sf_dir):
    """Learned forecasts against origin inventory and later sales: cases of the gated horizons."""
    from shelfline.operators import inventory as iv
    from shelfline.plans.inventory_fixture import later_sales, origin_inventory

    cases, _ = iv.paired_evaluation(
        learned_export(spark, sf_dir), origin_inventory(spark, sf_dir), later_sales(spark, sf_dir), "source-confirmed"
    )
    return cases.groupBy("horizon", "origin_exposure_state", "forecast_exposure_state", "comparison_case").agg(F.count(F.lit(1)).alias("cases"))


@query("model_replay", "M4 M15")
def model_replay(spark, sf_dir):
    """Save and reload an encoder, re-encode, and compare with the stored matrix."""
    from pyspark.ml import PipelineModel

    _, training, origins = _stored_inputs(spark, sf_dir, FOLDS[:1])
    rows = training.where("horizon = 7")
    fitted = mo.fit(rows, "ridge", "fixed")
    folder = scratch_path(spark, "model")
    PipelineModel(stages=[*fitted.encoder.stages, fitted.regressor]).write().save(folder)
    points = en.standardise(origins.withColumn("horizon", F.lit(7)), fitted.state)
    first = stored(
        fitted.predict(origins.withColumn("horizon", F.lit(7))).select(*SERIES, "prediction"),
        "replay",
    )
    again = PipelineModel.load(folder)
    differences = mo.replay_differences(again, points, first, SERIES)
    return first.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        differences.agg(F.count(F.lit(1)).alias("n")).scalar().alias("differences"),
    )


# --- requests ---------------------------------------------------------------

ORIGIN = date(1997, 12, 2)


def request_table(spark, sf_dir):
    """One request per series and horizon, broken by rule."""
    skus, whs = rank_tables(spark, sf_dir)
    demand = published_demand(spark, sf_dir).where(F.col("Date") <= F.lit(ORIGIN))
    base = (
        demand.groupBy(*SERIES)
        .agg(F.array_sort(F.collect_list(F.struct("Date", "Units_Sold"))).alias("_h"))
        .join(skus, "SKU_ID")
        .join(whs, "Warehouse_ID")
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 7, 14, 28)])))
        .withColumn("k", F.col("_sn") * 20 + F.col("_wn") * 4 + F.col("horizon"))
    )
    k = F.col("k")
    kept = F.when(k % 11 == 0, F.slice("_h", -21, 21)).otherwise(F.col("_h"))
    entries = F.transform(
        kept,
        lambda e, i: F.struct(
            F.when((k % 13 == 0) & (i == 5), F.date_add(e["Date"], 400))
            .otherwise(e["Date"])
            .cast("string")
            .alias("Date"),
            F.when((k % 17 == 0) & (i == 3), F.lit(-1.0))
            .when((k % 19 == 0) & (i == F.size(kept) - 2), F.lit(None))
            .otherwise(e["Units_Sold"].cast("double"))
            .alias("Units_Sold"),
        ),
    )
    return base.select(
        F.when(k % 23 == 0, "NOBODY").otherwise(F.col("SKU_ID")).alias("SKU_ID"),
        F.when(k % 29 == 0, "NOWHERE").otherwise(F.col("Warehouse_ID")).alias("Warehouse_ID"),
        F.when(k % 31 == 0, "1997-11-01")
        .when(k % 37 == 0, "1997-12-05")
        .otherwise(str(ORIGIN))
        .alias("forecast_origin"),
        F.when(k % 41 == 0, 3).otherwise(F.col("horizon")).alias("horizon"),
        F.lit("supplied_history").alias("input_kind"),
        entries.alias("history"),
        "k",
    )


REQUESTS_SQL = """
req AS (SELECT s.SKU_ID, w.Warehouse_ID, h AS horizon, sn * 20 + wn * 4 + h AS k FROM
  (SELECT DISTINCT SKU_ID, Warehouse_ID FROM demand) d JOIN sku_rank s USING (SKU_ID) JOIN wh_rank w USING (Warehouse_ID), (VALUES (1), (7), (14), (28)) AS v(h))"""


@query(
    "conditional_reject",
    "P9 S13",
    with_(PANEL, REQUESTS_SQL)
    + """SELECT CASE WHEN k % 23 = 0 THEN 'NOBODY' ELSE SKU_ID END AS SKU_ID, CASE WHEN k % 29 = 0 THEN 'NOWHERE' ELSE Warehouse_ID END AS Warehouse_ID,
CASE WHEN k % 41 = 0 THEN 3 ELSE horizon END AS horizon, k,
CASE WHEN k % 41 = 0 THEN 'unsupported_horizon' WHEN k % 23 = 0 THEN 'unknown_sku' WHEN k % 29 = 0 THEN 'unknown_warehouse'
WHEN k % 31 = 0 THEN 'invalid_origin' WHEN k % 11 = 0 THEN 'insufficient_history' WHEN k % 13 = 0 OR k % 17 = 0 THEN 'invalid_history'
WHEN k % 37 = 0 OR k % 19 = 0 THEN 'incomplete_history' END AS rejection FROM req""",
)
def conditional_reject(spark, sf_dir):
    demand = published_demand(spark, sf_dir)
    return rq.classify_with_tables(
        request_table(spark, sf_dir),
        demand.select("SKU_ID").distinct(),
        demand.select("Warehouse_ID").distinct(),
        ORIGIN,
    ).select(*SERIES, "horizon", "k", "rejection")


def _naive_scorers():
    """Seasonal baseline scorers; any function adding forecast_quantity will do."""
    def scorer(h):
        if h == 1:
            return lambda df: df.withColumn("forecast_quantity", F.col("lag_7"))
        return lambda df: df.withColumn("forecast_quantity", F.col("rolling_mean_7") * h)

    return {h: ("seasonal_naive", "not_tuned", scorer(h)) for h in (1, 7, 14, 28)}


def _classified(spark, sf_dir, requests):
    demand = published_demand(spark, sf_dir)
    return rq.classify_with_tables(
        requests,
        demand.select("SKU_ID").distinct(),
        demand.select("Warehouse_ID").distinct(),
        ORIGIN,
    )


SCORED_SQL = """
hist AS (SELECT SKU_ID, Warehouse_ID, avg(Units_Sold) AS m, max(Units_Sold) FILTER (Date = DATE '1997-11-26') AS w FROM demand WHERE Date BETWEEN DATE '1997-11-26' AND DATE '1997-12-02' GROUP BY 1, 2),
bad AS (SELECT *, k % 41 = 0 OR k % 23 = 0 OR k % 29 = 0 OR k % 31 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 37 = 0 OR k % 19 = 0 AS b FROM req)"""


SCORE_REQUESTS_SQL = (
    with_(PANEL, REQUESTS_SQL, SCORED_SQL)
    + """SELECT b.SKU_ID, b.Warehouse_ID, horizon, 'available' AS status, DATE '1997-12-03' AS target_start_date, DATE '1997-12-02' + CAST(horizon AS INTEGER) AS target_end_date,
CASE WHEN horizon = 1 THEN 'next_day' ELSE 'cumulative_window' END AS forecast_type, round(CASE WHEN horizon = 1 THEN CAST(w AS DOUBLE) ELSE m * horizon END, 6) AS forecast_quantity
FROM bad b JOIN hist h ON h.SKU_ID = b.SKU_ID AND h.Warehouse_ID = b.Warehouse_ID WHERE NOT b"""
)


@query("score_requests", "M16 M7", SCORE_REQUESTS_SQL)
def score_requests(spark, sf_dir):
    responses = rq.score_requests(
        _classified(spark, sf_dir, request_table(spark, sf_dir)), _naive_scorers()
    )
    out = responses.where("status = 'available'").select(
        *SERIES,
        "horizon",
        "status",
        "target_start_date",
        "target_end_date",
        "forecast_type",
        "forecast_quantity",
    )
    return r(out, "forecast_quantity")


@query(
    "request_features",
    "M16 W7",
    with_(
        PANEL,
        REQUESTS_SQL,
        SCORED_SQL,
    )
    + """, o AS (SELECT SKU_ID, Warehouse_ID, Units_Sold AS u, date_diff('day', Date, DATE '1997-12-03') AS age FROM demand WHERE Date BETWEEN DATE '1997-11-05' AND DATE '1997-12-02'),
f AS (SELECT SKU_ID, Warehouse_ID, CAST(max(u) FILTER (age = 1) AS DOUBLE) AS lag_1, CAST(max(u) FILTER (age = 7) AS DOUBLE) AS lag_7, CAST(max(u) FILTER (age = 14) AS DOUBLE) AS lag_14,
  avg(u) FILTER (age <= 7) AS rolling_mean_7, stddev_samp(u) FILTER (age <= 7) AS rolling_std_7, avg(u) FILTER (age <= 14) AS rolling_mean_14, stddev_samp(u) FILTER (age <= 14) AS rolling_std_14,
  avg(u) AS rolling_mean_28, stddev_samp(u) AS rolling_std_28, regr_slope(u, -age) FILTER (age <= 14) AS rolling_slope_14 FROM o GROUP BY 1, 2)
SELECT b.SKU_ID, b.Warehouse_ID, horizon, """
    + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES if not c.startswith("dow"))
    + " FROM bad b JOIN f ON f.SKU_ID = b.SKU_ID AND f.Warehouse_ID = b.Warehouse_ID WHERE NOT b",
)
def request_features(spark, sf_dir):
    ready = _classified(spark, sf_dir, request_table(spark, sf_dir)).where("rejection IS NULL")
    names = [c for c in FEATURES if not c.startswith("dow")]
    return r(rq.request_features(ready).select(*SERIES, "horizon", *names), *names)


@query(
    "changed_history_delta",
    "M22 V21",
    with_(PANEL, REQUESTS_SQL, SCORED_SQL)
    + """SELECT b.SKU_ID, b.Warehouse_ID, horizon, round(CASE WHEN horizon = 1 THEN 0.0 ELSE 10.0 / 7 * horizon END, 6) AS quantity_change, true AS hash_changed FROM bad b WHERE NOT b""",
)
def changed_history_delta(spark, sf_dir):
    requests = request_table(spark, sf_dir)
    scorers = _naive_scorers()
    before = rq.score_requests(_classified(spark, sf_dir, requests), scorers)
    after = rq.score_requests(
        _classified(spark, sf_dir, rq.changed_history(requests, 10.0)), scorers
    )
    keys = [*SERIES, "horizon"]
    ok = F.col("status") == "available"
    base = before.where(ok).select(
        *keys, F.col("forecast_quantity").alias("q0"), F.col("input_sha256").alias("h0")
    )
    joined = base.join(after.where(ok), keys)
    return r(
        joined.select(
            *keys,
            (F.col("forecast_quantity") - F.col("q0")).alias("quantity_change"),
            (F.col("input_sha256") != F.col("h0")).alias("hash_changed"),
        ),
        "quantity_change",
    )


RESPONSE_CATALOGUE = [
    ("identity", "Responses echo their request"),
    ("window", "Windows follow the origin and horizon"),
    ("quantity", "Quantities are finite and typed"),
    ("provenance", "Inputs are hashed"),
    ("leakage", "No outcome leaves the service"),
    ("rejection", "Rejections carry a known code"),
]


@query(
    "response_conformance",
    "V21 V20",
    with_(DEMAND)
    + " UNION ALL ".join(
        f"SELECT '{k}' AS requirement, '{t}' AS title, CASE WHEN count(*) > 0 THEN 'PASSED' END AS outcome, CAST({n} AS BIGINT) AS checks_total, '' AS checks_failed FROM demand"
        for (k, t), n in zip(RESPONSE_CATALOGUE, (1, 3, 2, 1, 2, 1))
    ),
)
def response_conformance(spark, sf_dir):
    responses = rq.score_requests(
        _classified(spark, sf_dir, request_table(spark, sf_dir)), _naive_scorers()
    )
    checks = rc.passed_rules(responses, rq.response_rules(responses))
    return rc.requirement_rollup(checks, RESPONSE_CATALOGUE)


@query("score_requests_with_model", "M16 M8")
def score_requests_with_model(spark, sf_dir):
    """Requests scored by ridge models refitted for each horizon."""
    _, training, _ = _stored_inputs(spark, sf_dir, FOLDS[4:])
    scorers = {}
    for h in (1, 7, 14, 28):
        fitted = mo.fit(training.where(F.col("horizon") == h), "ridge", "fixed")
        scorers[h] = (
            "ridge",
            "fixed",
            lambda df, m=fitted: m.predict(
                df.withColumn("fold_id", F.lit(5)), "forecast_quantity"
            ),
        )
    return rq.score_requests(
        _classified(spark, sf_dir, request_table(spark, sf_dir)), scorers
    ).select(*SERIES, "horizon", "status", "reason_code", "forecast_quantity", "model")


@query("score_request_stream", "M16 S13", SCORE_REQUESTS_SQL)
def score_request_stream(spark, sf_dir):
    """The same scoring as a stateless stream over request files."""
    folder = scratch_path(spark, "requests")
    request_table(spark, sf_dir).drop("k").write.mode("errorifexists").json(folder)
    demand = published_demand(spark, sf_dir)
    skus = stored(demand.select("SKU_ID").distinct(), "skus")
    whs = stored(demand.select("Warehouse_ID").distinct(), "warehouses")
    responses = stream.score_stream(
        stream.read_request_stream(spark, folder), skus, whs, ORIGIN, _naive_scorers()
    )
    out = scratch_path(spark, "responses")
    running = stream.start_scoring(responses, out, scratch_path(spark, "stream-state"))
    running.awaitTermination()
    scored = spark.read.parquet(out).where("status = 'available'").select(
        *SERIES,
        "horizon",
        "status",
        "target_start_date",
        "target_end_date",
        "forecast_type",
        "forecast_quantity",
    )
    return r(scored, "forecast_quantity")
