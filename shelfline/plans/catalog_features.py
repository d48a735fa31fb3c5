"""Feature, target and fold queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, HORIZONS, SERIES, fold_calendar
from shelfline.operators import features as fe
from shelfline.operators import folds as fo
from shelfline.plans.oracle_base import DEMAND, GAP, whole, with_
from shelfline.plans.registry import query
from shelfline.sources.panels import FULL_END, FULL_START, full_demand, gap_panel

YEAR = 1997
FOLDS = fold_calendar(YEAR)
ORIGIN = FOLDS[-1].end

STD = [c for c in FEATURES]


def rounded(names, digits=6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def feature_sql(source: str, name: str = "features", extra: str = "") -> str:
    """Independent SQL for the features over relation ``source``."""
    def frame(lo, hi):
        return (
            "OVER (PARTITION BY SKU_ID, Warehouse_ID ORDER BY Date RANGE BETWEEN "
            f"INTERVAL {lo} DAY PRECEDING AND INTERVAL {hi} DAY PRECEDING)"
        )

    parts = [
        "sin(2 * pi() * (isodow(Date) - 1) / 7) AS dow_sin",
        "cos(2 * pi() * (isodow(Date) - 1) / 7) AS dow_cos",
    ]
    for k in (1, 7, 14):
        parts.append(f"max(CAST(Units_Sold AS DOUBLE)) {frame(k, k)} AS lag_{k}")
    for w in (7, 14, 28):
        f = frame(w, 1)
        parts.append(
            f"CASE WHEN count(Units_Sold) {f} = {w} THEN avg(Units_Sold) {f} END AS rolling_mean_{w}"
        )
        parts.append(
            f"CASE WHEN count(Units_Sold) {f} = {w} THEN stddev_samp(Units_Sold) {f} END AS rolling_std_{w}"
        )
    f = frame(14, 1)
    parts.append(
        f"CASE WHEN count(Units_Sold) {f} = 14 THEN "
        f"regr_slope(Units_Sold, date_diff('day', DATE '1970-01-01', Date)) {f} END AS rolling_slope_14"
    )
    return (
        f"{name} AS (SELECT SKU_ID, Warehouse_ID, Date, Units_Sold{extra}, "
        + ", ".join(parts)
        + f" FROM {source})"
    )


def target_sql(source: str, name: str = "targets") -> str:
    parts = []
    for h in HORIZONS:
        f = (
            "OVER (PARTITION BY SKU_ID, Warehouse_ID ORDER BY Date RANGE BETWEEN CURRENT ROW "
            f"AND INTERVAL {h - 1} DAY FOLLOWING)"
        )
        parts.append(
            f"CASE WHEN count(Units_Sold) {f} = {h} THEN CAST(sum(Units_Sold) {f} AS DOUBLE) END "
            f"AS target_{h}_day"
        )
    return f"{name} AS (SELECT SKU_ID, Warehouse_ID, Date, {', '.join(parts)} FROM {source})"


def r6(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


READY_SQL = " AND ".join(f"{n} IS NOT NULL" for n in FEATURES)
TARGETS = [f"target_{h}_day" for h in HORIZONS]


@query(
    "build_features",
    "W1 W2 W3 W4 W5 W6 J1 J3 P3 S3",
    with_(GAP, feature_sql("gap"), target_sql("gap"))
    + f"""
SELECT f.SKU_ID, f.Warehouse_ID, f.Date, {r6(FEATURES)}, {', '.join('t.' + t for t in TARGETS)},
       ({READY_SQL}) AS feature_eligible
FROM features AS f JOIN targets AS t USING (SKU_ID, Warehouse_ID, Date)""",
)
def build_features(spark, sf_dir):
    rows = fe.features_and_targets(gap_panel(spark, sf_dir))
    return rows.select(
        *SERIES, "Date", *rounded(FEATURES), *TARGETS, fe.eligible().alias("feature_eligible")
    )


@query(
    "features_dense_panel",
    "W1 W2 W3 W4 W5",
    with_(whole(DEMAND), feature_sql("demand")) + f"SELECT SKU_ID, Warehouse_ID, Date, {r6(FEATURES)} FROM features",
)
def features_dense(spark, sf_dir):
    return fe.build_features(full_demand(spark, sf_dir, whole=True)).select(
        *SERIES, "Date", *rounded(FEATURES)
    )


@query(
    "calendar_features",
    "W1",
    with_(whole(DEMAND))
    + """SELECT Date, count(*) AS series, round(sin(2 * pi() * (isodow(Date) - 1) / 7), 6) AS dow_sin,
    round(cos(2 * pi() * (isodow(Date) - 1) / 7), 6) AS dow_cos FROM demand GROUP BY Date""",
)
def calendar_features(spark, sf_dir):
    per_day = full_demand(spark, sf_dir, whole=True).groupBy("Date").agg(F.count(F.lit(1)).alias("series"))
    phase = fe.calendar_phase(F.col("Date"))
    return per_day.select(
        "Date", "series", *[F.round(c, 6).alias(n) for n, c in phase.items()]
    )


@query(
    "calendar_lags",
    "W2 J3",
    with_(GAP)
    + """SELECT g.SKU_ID, g.Warehouse_ID, g.Date, CAST(a.Units_Sold AS DOUBLE) AS lag_1,
    CAST(b.Units_Sold AS DOUBLE) AS lag_7, CAST(c.Units_Sold AS DOUBLE) AS lag_14
FROM gap g
LEFT JOIN gap a ON a.SKU_ID = g.SKU_ID AND a.Warehouse_ID = g.Warehouse_ID AND a.Date = g.Date - 1
LEFT JOIN gap b ON b.SKU_ID = g.SKU_ID AND b.Warehouse_ID = g.Warehouse_ID AND b.Date = g.Date - 7
LEFT JOIN gap c ON c.SKU_ID = g.SKU_ID AND c.Warehouse_ID = g.Warehouse_ID AND c.Date = g.Date - 14""",
)
def calendar_lags(spark, sf_dir):
    return fe.build_features(gap_panel(spark, sf_dir)).select(
        *SERIES, "Date", "lag_1", "lag_7", "lag_14"
    )


@query(
    "masked_history_features",
    "W2 W3 W4 W5 V13",
    with_(
        GAP,
        "masked AS (SELECT SKU_ID, Warehouse_ID, Date, CASE WHEN Date <= DATE '1997-12-02' THEN "
        "Units_Sold END AS Units_Sold FROM gap)",
        feature_sql("masked"),
    )
    + f"SELECT SKU_ID, Warehouse_ID, Date, {r6(FEATURES)} FROM features",
)
def masked_features(spark, sf_dir):
    return fe.build_features(gap_panel(spark, sf_dir), history_end=ORIGIN).select(
        *SERIES, "Date", *rounded(FEATURES)
    )


@query(
    "horizon_targets",
    "W6",
    with_(
        whole(DEMAND),
        "inside AS (SELECT SKU_ID, Warehouse_ID, Date, CASE WHEN Date BETWEEN DATE '1997-01-01' AND "
        "DATE '1997-09-30' THEN Units_Sold END AS Units_Sold FROM demand)",
        target_sql("inside"),
    )
    + "SELECT * FROM targets",
)
def horizon_targets(spark, sf_dir):
    return fe.build_targets(full_demand(spark, sf_dir, whole=True), date(YEAR, 1, 1), date(YEAR, 9, 30))


ORIGIN_ROWS = """
origins AS (SELECT * FROM (VALUES (1, DATE '1997-03-31'), (2, DATE '1997-06-30'),
  (3, DATE '1997-09-30'), (4, DATE '1997-11-04'), (5, DATE '1997-12-02')) AS t(fold_id, origin))"""


@query(
    "origin_features",
    "W7 U2",
    with_(
        DEMAND,
        ORIGIN_ROWS,
        "hist AS (SELECT fold_id, SKU_ID, Warehouse_ID, Date, Units_Sold FROM demand JOIN origins ON Date <= origin "
        "UNION ALL SELECT fold_id, SKU_ID, Warehouse_ID, origin + 1, NULL FROM origins, "
        "(SELECT DISTINCT SKU_ID, Warehouse_ID FROM demand) AS roster)",
        feature_sql("hist", extra=", fold_id").replace(
            "PARTITION BY SKU_ID", "PARTITION BY fold_id, SKU_ID"
        ),
    )
    + f"""SELECT fold_id, SKU_ID, Warehouse_ID, f.Date, {r6(FEATURES)}
FROM features AS f JOIN origins USING (fold_id) WHERE f.Date = origin + 1""",
)
def origin_features(spark, sf_dir):
    return fe.origin_features(full_demand(spark, sf_dir), FOLDS).select(
        "fold_id", *SERIES, "Date", *rounded(FEATURES)
    )


@query(
    "origin_features_gap",
    "W7 U2",
    with_(
        GAP,
        "hist AS (SELECT SKU_ID, Warehouse_ID, Date, Units_Sold FROM gap WHERE Date <= DATE '1997-12-02' "
        "UNION ALL SELECT DISTINCT SKU_ID, Warehouse_ID, DATE '1997-12-03', NULL FROM gap "
        "WHERE Date <= DATE '1997-12-02')",
        feature_sql("hist"),
    )
    + f"SELECT SKU_ID, Warehouse_ID, Date, {r6(FEATURES)} FROM features WHERE Date = DATE '1997-12-03'",
)
def origin_features_gap(spark, sf_dir):
    return fe.origin_features(gap_panel(spark, sf_dir), FOLDS[-1:]).select(
        *SERIES, "Date", *rounded(FEATURES)
    )


FOLD_TABLE = """
folds AS (SELECT * FROM (VALUES
  (1, DATE '1997-01-01', DATE '1997-03-31', DATE '1997-04-01', DATE '1997-04-28'),
  (2, DATE '1997-01-01', DATE '1997-06-30', DATE '1997-07-01', DATE '1997-07-28'),
  (3, DATE '1997-01-01', DATE '1997-09-30', DATE '1997-10-01', DATE '1997-10-28'),
  (4, DATE '1997-01-01', DATE '1997-11-04', DATE '1997-11-05', DATE '1997-12-02'),
  (5, DATE '1997-01-01', DATE '1997-12-02', DATE '1997-12-03', DATE '1997-12-30'))
  AS t(fold_id, training_start, training_end, outcome_start, outcome_end))"""


@query(
    "scope_dates",
    "P1",
    with_(DEMAND)
    + "SELECT * FROM demand WHERE Date BETWEEN DATE '1997-01-01' AND DATE '1997-07-28'",
)
def scope_dates(spark, sf_dir):
    return full_demand(spark, sf_dir).where(
        F.col("Date").between(F.lit(FOLDS[1].start), F.lit(FOLDS[1].outcome_end))
    )


@query(
    "fold_split",
    "P2",
    with_(DEMAND, FOLD_TABLE)
    + """SELECT fold_id, CASE WHEN Date <= training_end THEN 'training' ELSE 'validation' END AS slice,
    count(*) AS n_rows, count(DISTINCT Date) AS days, CAST(sum(Units_Sold) AS BIGINT) AS units
FROM demand JOIN folds ON Date BETWEEN training_start AND outcome_end GROUP BY 1, 2""",
)
def fold_split(spark, sf_dir):
    return (
        fo.assign_folds(full_demand(spark, sf_dir), FOLDS)
        .groupBy("fold_id", "slice")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("Date").alias("days"),
            F.sum("Units_Sold").alias("units"),
        )
    )


@query(
    "fold_coverage",
    "V15",
    with_(GAP, FOLD_TABLE)
    + """SELECT fold_id, SKU_ID, Warehouse_ID,
    count(DISTINCT CASE WHEN Date <= training_end THEN Date END) AS training_days,
    date_diff('day', training_start, training_end) + 1 AS expected_training_days,
    count(DISTINCT CASE WHEN Date > training_end THEN Date END) AS validation_days,
    date_diff('day', outcome_start, outcome_end) + 1 AS expected_validation_days,
    count(DISTINCT CASE WHEN Date <= training_end THEN Date END) = date_diff('day', training_start, training_end) + 1
      AND count(DISTINCT CASE WHEN Date > training_end THEN Date END) = date_diff('day', outcome_start, outcome_end) + 1
      AS complete
FROM gap JOIN folds ON Date BETWEEN training_start AND outcome_end
GROUP BY fold_id, SKU_ID, Warehouse_ID, training_start, training_end, outcome_start, outcome_end""",
)
def fold_coverage(spark, sf_dir):
    return fo.fold_coverage(gap_panel(spark, sf_dir), FOLDS)


@query(
    "feature_eligible",
    "P3",
    with_(GAP, feature_sql("gap"))
    + f"SELECT SKU_ID, Warehouse_ID, count(*) AS n_rows, count(*) FILTER ({READY_SQL}) AS eligible_rows "
    "FROM features GROUP BY 1, 2",
)
def feature_eligible(spark, sf_dir):
    return (
        fe.build_features(gap_panel(spark, sf_dir))
        .groupBy(*SERIES)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(fe.eligible()).alias("eligible_rows"),
        )
    )


def prepared_sql(source_cte: str, source: str) -> list[str]:
    return [
        source_cte,
        FOLD_TABLE,
        feature_sql(source),
        target_sql(source),
        f"prepared AS (SELECT f.*, {', '.join('t.' + t for t in TARGETS)}, ({READY_SQL}) AS ready "
        "FROM features f JOIN targets t USING (SKU_ID, Warehouse_ID, Date))",
        "long AS ("
        + " UNION ALL ".join(
            f"SELECT *, {h} AS horizon, target_{h}_day AS target FROM prepared" for h in HORIZONS
        )
        + ")",
        "tagged AS (SELECT l.*, fold_id, training_end, "
        "Date + CAST(horizon - 1 AS INTEGER) <= training_end AS inside FROM long l JOIN folds ON "
        "Date BETWEEN training_start AND training_end)",
    ]


@query(
    "label_boundary",
    "P4 M5",
    with_(*prepared_sql(DEMAND, "demand"))
    + """SELECT fold_id, horizon, count(*) AS training_rows, CAST(sum(target) AS DOUBLE) AS target_total,
    min(Date) AS first_date, max(Date) AS last_date
FROM tagged WHERE ready AND inside AND target IS NOT NULL GROUP BY 1, 2""",
)
def label_boundary(spark, sf_dir):
    rows = fo.training_rows(fe.features_and_targets(full_demand(spark, sf_dir)), FOLDS)
    return rows.groupBy("fold_id", "horizon").agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.sum("target").alias("target_total"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    )


def _eligibility_sql(cte, source):
    return (
        with_(*prepared_sql(cte, source))
        + """,
flags AS (SELECT *, NOT ready AS a, NOT inside AS b, inside AND target IS NULL AS c FROM tagged)
SELECT fold_id, horizon, SKU_ID, Warehouse_ID, count(*) AS raw_row_count,
  count(*) FILTER (ready) AS feature_eligible_count,
  count(*) FILTER (target IS NOT NULL AND inside) AS label_eligible_count,
  count(*) FILTER (target IS NOT NULL AND inside AND ready) AS training_row_count,
  count(*) FILTER (a) AS incomplete_predictor_history,
  count(*) FILTER (b) AS target_after_training_cutoff,
  count(*) FILTER (c) AS missing_observed_training_target,
  concat_ws(';',
    CASE WHEN bool_or(a AND (b OR c)) THEN 'incomplete_predictor_history' END,
    CASE WHEN bool_or(b AND (a OR c)) THEN 'target_after_training_cutoff' END,
    CASE WHEN bool_or(c AND (a OR b)) THEN 'missing_observed_training_target' END)
    AS overlapping_reasons
FROM flags GROUP BY 1, 2, 3, 4"""
    )


@query("eligibility_counts", "A22 M5", _eligibility_sql(DEMAND, "demand"))
def eligibility_counts(spark, sf_dir):
    return fo.eligibility_counts(fe.features_and_targets(full_demand(spark, sf_dir)), FOLDS)


@query("eligibility_counts_gap", "A22 M5", _eligibility_sql(GAP, "gap"))
def eligibility_counts_gap(spark, sf_dir):
    return fo.eligibility_counts(fe.features_and_targets(gap_panel(spark, sf_dir)), FOLDS)


@query(
    "origin_outcome_join",
    "J2",
    with_(DEMAND, FOLD_TABLE, target_sql("demand"))
    + """, observed AS (SELECT fold_id, SKU_ID, Warehouse_ID, target_1_day, target_7_day, target_14_day, target_28_day
  FROM targets JOIN folds ON Date = outcome_start)
SELECT fold_id, r.SKU_ID, r.Warehouse_ID, target_1_day, target_7_day, target_14_day, target_28_day,
  target_1_day IS NULL OR target_7_day IS NULL OR target_14_day IS NULL OR target_28_day IS NULL AS incomplete
FROM (SELECT DISTINCT fold_id, SKU_ID, Warehouse_ID FROM demand, folds) r
LEFT JOIN observed o USING (fold_id, SKU_ID, Warehouse_ID)""",
)
def origin_outcome_join(spark, sf_dir):
    demand = full_demand(spark, sf_dir)
    origins = fe.origin_features(demand, FOLDS).select("fold_id", *SERIES)
    observed = (
        fo.observed_targets(fe.build_targets(demand, FULL_START, FULL_END), FOLDS)
        .groupBy("fold_id", *SERIES)
        .pivot("horizon", list(HORIZONS))
        .agg(F.first("observed_target"))
    )
    named = observed.select(
        "fold_id", *SERIES, *[F.col(str(h)).alias(f"target_{h}_day") for h in HORIZONS]
    )
    joined = origins.join(named, ["fold_id", *SERIES], "left")
    missing = F.lit(False)
    for t in TARGETS:
        missing = missing | F.col(t).isNull()
    return joined.withColumn("incomplete", missing)
