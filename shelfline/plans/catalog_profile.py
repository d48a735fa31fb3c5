"""Descriptive profile queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from shelfline.fixed import INVENTORY_COLUMNS, PROFILE_LAGS, SERIES
from shelfline.operators import profile as pr
from shelfline.plans import oracle_base
from shelfline.plans.oracle_base import EVENT, GAP, whole, with_
from shelfline.plans.registry import query
from shelfline.sources import panels
from shelfline.sources.panels import event_panel, gap_panel

# descriptions cover the whole log
DEMAND, PANEL = whole(oracle_base.DEMAND), whole(oracle_base.PANEL)
full_demand = partial(panels.full_demand, whole=True)
full_panel = partial(panels.full_panel, whole=True)


def r(df, *names, digits=6):
    return df.select(
        *[F.round(c, digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns]
    )


SUMMARY = """count(*) AS rows, count(DISTINCT Date) AS days, CAST(sum(Units_Sold) AS BIGINT) AS total,
round(avg(Units_Sold), 6) AS mean, CAST(median(Units_Sold) AS DOUBLE) AS median,
round(stddev_samp(Units_Sold), 6) AS std,
round(avg(CASE WHEN Units_Sold = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share,
round(avg(CAST(Promotion_Flag AS DOUBLE)), 6) AS promotion_share"""
ROUNDED = ("mean", "std", "zero_share", "promotion_share")
PERIODS = (
    "periods AS (SELECT *, strftime(Date, '%Y-%m') AS month, year(Date) || 'Q' || quarter(Date) AS quarter FROM panel)"
)

SETS = {
    "date": ["Date"],
    "month": ["month"],
    "quarter": ["quarter"],
    "promotion": ["Promotion_Flag"],
    "month_promotion": ["month", "Promotion_Flag"],
    "series_promotion": [*SERIES, "Promotion_Flag"],
    "series": list(SERIES),
    "sku_month": ["SKU_ID", "month"],
    "warehouse_month": ["Warehouse_ID", "month"],
}
SET_COLUMNS = ["Date", "month", "quarter", "Promotion_Flag", *SERIES]


def _sets_sql():
    blocks = []
    for label, names in SETS.items():
        kinds = {"Date": "DATE", "Promotion_Flag": "INTEGER"}
        columns = ", ".join(
            c if c in names else f"CAST(NULL AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in SET_COLUMNS
        )
        blocks.append(
            f"SELECT '{label}' AS \"grouping\", {columns}, {SUMMARY} FROM periods GROUP BY {', '.join(names)}"
        )
    return with_(PANEL, PERIODS) + " UNION ALL ".join(blocks)


@query("demand_summary", "A1", _sets_sql())
def demand_summary(spark, sf_dir):
    panel = pr.with_periods(full_panel(spark, sf_dir))
    return r(pr.summarize_many(panel, SETS), *ROUNDED)


@query(
    "demand_summary_by_series",
    "A1 A3",
    with_(PANEL)
    + f"""SELECT SKU_ID, Warehouse_ID, {SUMMARY},
round(stddev_samp(Units_Sold) / nullif(avg(Units_Sold), 0), 6) AS coefficient_of_variation
FROM panel GROUP BY 1, 2""",
)
def demand_summary_by_series(spark, sf_dir):
    return r(
        pr.series_profile(full_panel(spark, sf_dir)), *ROUNDED, "coefficient_of_variation"
    )


@query(
    "series_cv",
    "A3",
    with_(GAP)
    + """SELECT SKU_ID, Warehouse_ID, round(stddev_samp(Units_Sold) / nullif(avg(Units_Sold), 0), 6) AS coefficient_of_variation
FROM gap GROUP BY 1, 2""",
)
def series_cv(spark, sf_dir):
    from shelfline.functions.expr import ratio

    return (
        gap_panel(spark, sf_dir)
        .groupBy(*SERIES)
        .agg(
            F.round(ratio(F.stddev_samp("Units_Sold"), F.avg("Units_Sold")), 6).alias(
                "coefficient_of_variation"
            )
        )
    )


def _distribution_sql():
    parts = [
        ("count", "CAST(count(Units_Sold) AS DOUBLE)"),
        ("mean", "avg(Units_Sold)"),
        ("std", "stddev_samp(Units_Sold)"),
        ("min", "CAST(min(Units_Sold) AS DOUBLE)"),
    ]
    parts += [
        (n, f"CAST(quantile_cont(Units_Sold, {p}) AS DOUBLE)") for n, p in pr.DISTRIBUTION.items()
    ]
    parts.append(("max", "CAST(max(Units_Sold) AS DOUBLE)"))
    return with_(GAP) + " UNION ALL ".join(
        f"SELECT '{n}' AS statistic, round({e}, 6) AS value FROM gap" for n, e in parts
    )


@query("distribution", "A2", _distribution_sql())
def distribution(spark, sf_dir):
    return r(pr.distribution(gap_panel(spark, sf_dir)), "value")


WEEK = "CAST(date_trunc('week', Date) AS DATE)"
GRAIN_SQL = f"""
grains AS (
  SELECT 'sku_day' AS analytical_unit, SKU_ID, CAST(NULL AS VARCHAR) AS Warehouse_ID, Date AS period,
         CAST(sum(Units_Sold) AS BIGINT) AS demand FROM {{src}} GROUP BY SKU_ID, Date
  UNION ALL SELECT 'sku_warehouse_day', SKU_ID, Warehouse_ID, Date, CAST(sum(Units_Sold) AS BIGINT)
         FROM {{src}} GROUP BY SKU_ID, Warehouse_ID, Date
  UNION ALL SELECT 'sku_week', SKU_ID, NULL, {WEEK}, CAST(sum(Units_Sold) AS BIGINT)
         FROM {{src}} GROUP BY SKU_ID, {WEEK})"""


@query(
    "regrain",
    "A4 U1",
    with_(GAP, GRAIN_SQL.format(src="gap"))
    + "SELECT analytical_unit, SKU_ID, Warehouse_ID, period, demand FROM grains",
)
def regrain(spark, sf_dir):
    return pr.regrain(gap_panel(spark, sf_dir), *pr.GRAINS)


STATS_SQL = """
lagged AS (SELECT *, lag(demand) OVER (PARTITION BY analytical_unit, SKU_ID, Warehouse_ID ORDER BY period) AS prev FROM grains),
stats AS (SELECT analytical_unit, SKU_ID, Warehouse_ID, count(*) AS n, avg(demand) AS mean, stddev_samp(demand) AS std,
  avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) AS zero,
  CASE WHEN count(prev) >= 2 AND min(CASE WHEN prev IS NOT NULL THEN demand END) < max(CASE WHEN prev IS NOT NULL THEN demand END)
       AND min(prev) < max(prev) THEN corr(demand, prev) END AS lag1,
  least(1.0, count(DISTINCT period) / CAST(date_diff('day', min(period), max(period)) // (CASE WHEN analytical_unit = 'sku_week' THEN 7 ELSE 1 END) + 1 AS DOUBLE)) AS comp
  FROM lagged GROUP BY 1, 2, 3)"""


@query(
    "grain_comparison",
    "A5 U1",
    with_(GAP, GRAIN_SQL.format(src="gap"), STATS_SQL)
    + """SELECT analytical_unit, count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_rows,
round(CAST(median(n) AS DOUBLE), 6) AS median_observations_per_series, round(median(CAST(zero AS DOUBLE)), 6) AS median_zero_demand_share,
round(median(std / nullif(mean, 0)), 6) AS median_coefficient_of_variation, round(median(lag1), 6) AS median_lag1_autocorrelation,
round(median(CAST(comp AS DOUBLE)), 6) AS median_temporal_completeness, round(median(mean), 6) AS median_mean_demand
FROM stats GROUP BY 1""",
)
def grain_comparison(spark, sf_dir):
    out = pr.grain_comparison(gap_panel(spark, sf_dir))
    return r(out, *[c for c in out.columns if c.startswith("median_")])


def _facts(parts, source="panel"):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", CAST({e} AS VARCHAR) AS value FROM {source}" for n, e in parts
    )


@query(
    "source_constraints",
    "A6",
    with_(PANEL)
    + _facts(
        [
            ("row_count", "count(*)"),
            ("date_min", "min(Date)"),
            ("date_max", "max(Date)"),
            ("unique_dates", "count(DISTINCT Date)"),
            ("unique_skus", "count(DISTINCT SKU_ID)"),
            ("unique_warehouses", "count(DISTINCT Warehouse_ID)"),
            ("stockout_flag_unique_values", "count(DISTINCT Stockout_Flag)"),
            ("stockout_flag_positive_rows", "count(*) FILTER (Stockout_Flag = 1)"),
            ("nonzero_order_quantity_rows", "count(*) FILTER (Order_Quantity > 0)"),
            ("Demand_Forecast_present", "max(true)"),
            ("Stockout_Flag_present", "max(true)"),
        ]
    ),
)
def source_constraints(spark, sf_dir):
    return pr.source_constraints(full_panel(spark, sf_dir))


@query(
    "promotion_consistency",
    "A7",
    with_(PANEL)
    + """, g AS (SELECT Date, SKU_ID, count(DISTINCT Promotion_Flag) AS v FROM panel GROUP BY 1, 2)
SELECT count(*) AS sku_day_groups, count(*) FILTER (v > 1) AS groups_with_conflicting_promotion_flag,
round(count(*) FILTER (v > 1) / CAST(count(*) AS DOUBLE), 6) AS conflict_share FROM g""",
)
def promotion_consistency(spark, sf_dir):
    return r(pr.promotion_consistency(full_panel(spark, sf_dir)), "conflict_share")


@query(
    "native_grain",
    "A8",
    """WITH raw AS (SELECT CAST(l_shipdate AS DATE) AS Date, l_returnflag AS SKU_ID, l_linestatus AS Warehouse_ID FROM lineitem),
k AS (SELECT Date, SKU_ID, Warehouse_ID, count(*) AS n FROM raw GROUP BY 1, 2, 3)
SELECT 'source_rows' AS "check", CAST(sum(n) AS BIGINT) AS value FROM k
UNION ALL SELECT 'unique_date_sku_warehouse_keys', count(*) FROM k
UNION ALL SELECT 'duplicate_rows_at_native_key', CAST(COALESCE(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM k
UNION ALL SELECT 'native_key_is_unique', CAST(COALESCE(sum(n) FILTER (n > 1), 0) = 0 AS BIGINT) FROM k""",
)
def native_grain(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.to_date("l_shipdate").alias("Date"),
        F.col("l_returnflag").alias("SKU_ID"),
        F.col("l_linestatus").alias("Warehouse_ID"),
    )
    return pr.native_grain(log)


@query(
    "cross_warehouse_variation",
    "A9",
    with_(PANEL)
    + ", g AS (SELECT Date, SKU_ID, "
    + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in INVENTORY_COLUMNS)
    + " FROM panel GROUP BY 1, 2) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) AS sku_day_groups, count(*) FILTER ({c} > 1) AS groups_with_cross_warehouse_variation, "
        f"count(*) FILTER ({c} = 1) AS groups_constant_across_warehouses, round(count(*) FILTER ({c} > 1) / CAST(count(*) AS DOUBLE), 6) AS variation_share FROM g"
        for c in INVENTORY_COLUMNS
    ),
)
def cross_warehouse_variation(spark, sf_dir):
    return r(pr.cross_warehouse_variation(full_panel(spark, sf_dir)), "variation_share")


@query(
    "warehouse_coverage",
    "A10",
    with_(GAP)
    + """, g AS (SELECT Date, SKU_ID, count(DISTINCT Warehouse_ID) AS w FROM gap GROUP BY 1, 2)
SELECT w AS warehouses_per_sku_day, count(*) AS sku_day_groups, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM g GROUP BY 1""",
)
def warehouse_coverage(spark, sf_dir):
    return r(pr.warehouse_coverage(gap_panel(spark, sf_dir)), "share")


@query(
    "inventory_ranges",
    "A11",
    with_(PANEL)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(min({c}) AS DOUBLE) AS min, CAST(median({c}) AS DOUBLE) AS median, round(avg({c}), 6) AS mean, "
        f"CAST(max({c}) AS DOUBLE) AS max, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM panel"
        for c in INVENTORY_COLUMNS
    ),
)
def inventory_ranges(spark, sf_dir):
    return r(pr.inventory_ranges(full_panel(spark, sf_dir)), "mean", "zero_share")


def _monthly(entity):
    return (
        f"mm AS (SELECT {entity} AS e, strftime(Date, '%Y-%m') AS month, count(*) AS rows, "
        f"CAST(sum(Units_Sold) AS BIGINT) AS total, avg(Units_Sold) AS mean FROM demand GROUP BY 1, 2)"
    )


@query(
    "profile_index",
    "A12",
    with_(DEMAND, _monthly("SKU_ID"))
    + """SELECT e AS SKU_ID, month, rows, total, round(mean, 6) AS mean,
round(mean / nullif(sum(total) OVER (PARTITION BY e) / CAST(sum(rows) OVER (PARTITION BY e) AS DOUBLE), 0), 6) AS mean_index FROM mm""",
)
def profile_index(spark, sf_dir):
    return r(pr.profile_index(full_demand(spark, sf_dir), "SKU_ID"), "mean", "mean_index")


@query(
    "profile_index_warehouse",
    "A12",
    with_(DEMAND, _monthly("Warehouse_ID"))
    + """SELECT e AS Warehouse_ID, month, rows, total, round(mean, 6) AS mean,
round(mean / nullif(sum(total) OVER (PARTITION BY e) / CAST(sum(rows) OVER (PARTITION BY e) AS DOUBLE), 0), 6) AS mean_index FROM mm""",
)
def profile_index_warehouse(spark, sf_dir):
    return r(pr.profile_index(full_demand(spark, sf_dir), "Warehouse_ID"), "mean", "mean_index")


@query(
    "variation_ratio",
    "A13",
    with_(DEMAND, _monthly("SKU_ID"))
    + """SELECT e AS SKU_ID, round(min(mean), 6) AS min_month_mean, round(max(mean), 6) AS max_month_mean,
round(max(mean) / nullif(min(mean), 0), 6) AS max_min_ratio FROM mm GROUP BY 1""",
)
def variation_ratio(spark, sf_dir):
    return r(
        pr.variation_ratio(full_demand(spark, sf_dir), "SKU_ID"),
        "min_month_mean",
        "max_month_mean",
        "max_min_ratio",
    )


def _pairs(entity):
    return (
        with_(DEMAND, _monthly(entity))
        + """, p AS (SELECT a.e AS x, b.e AS y, corr(a.mean, b.mean) AS c FROM mm a JOIN mm b ON a.month = b.month AND a.e < b.e GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std FROM p"""
    )


@query("pattern_similarity", "A14", _pairs("SKU_ID"))
def pattern_similarity(spark, sf_dir):
    return r(pr.pattern_similarity(full_demand(spark, sf_dir), "SKU_ID"), "mean", "std")


@query("pattern_similarity_warehouse", "A14", _pairs("Warehouse_ID"))
def pattern_similarity_warehouse(spark, sf_dir):
    return r(pr.pattern_similarity(full_demand(spark, sf_dir), "Warehouse_ID"), "mean", "std")


def _lags(source):
    blocks = []
    for k in PROFILE_LAGS:
        blocks.append(
            f"SELECT t.SKU_ID, t.Warehouse_ID, {k} AS lag_days, t.u AS a, l.u AS b, t.d AS da, l.d AS db FROM x t "
            f"LEFT JOIN x l ON l.SKU_ID = t.SKU_ID AND l.Warehouse_ID = t.Warehouse_ID AND l.Date = t.Date - {k}"
        )
    return f"""x AS (SELECT t.SKU_ID, t.Warehouse_ID, t.Date, CAST(t.Units_Sold AS DOUBLE) AS u, CAST(t.Units_Sold - p.Units_Sold AS DOUBLE) AS d
  FROM {source} t LEFT JOIN {source} p ON p.SKU_ID = t.SKU_ID AND p.Warehouse_ID = t.Warehouse_ID AND p.Date = t.Date - 1),
pairs AS ({' UNION ALL '.join(blocks)}),
lags AS (SELECT SKU_ID, Warehouse_ID, lag_days,
  CASE WHEN count(*) FILTER (b IS NOT NULL) >= 3 AND min(a) FILTER (b IS NOT NULL) < max(a) FILTER (b IS NOT NULL) AND min(b) < max(b)
    THEN corr(a, b) END AS correlation,
  CASE WHEN count(*) FILTER (da IS NOT NULL AND db IS NOT NULL) >= 3
    AND min(da) FILTER (db IS NOT NULL) < max(da) FILTER (db IS NOT NULL)
    AND min(db) FILTER (da IS NOT NULL) < max(db) FILTER (da IS NOT NULL) THEN corr(da, db) END AS differenced_correlation
  FROM pairs GROUP BY 1, 2, 3)"""


@query(
    "lag_correlation",
    "A15",
    with_(GAP, _lags("gap"))
    + "SELECT SKU_ID, Warehouse_ID, lag_days, round(correlation, 6) AS correlation, round(differenced_correlation, 6) AS differenced_correlation FROM lags",
)
def lag_correlation(spark, sf_dir):
    return r(
        pr.lag_correlation(gap_panel(spark, sf_dir)), "correlation", "differenced_correlation"
    )


LAG_SUMMARY = """SELECT lag_days, count(correlation) AS defined_series, round(median(correlation), 6) AS median,
round(quantile_cont(correlation, 0.25), 6) AS q25, round(quantile_cont(correlation, 0.75), 6) AS q75,
round(min(correlation), 6) AS min, round(max(correlation), 6) AS max, round(median(differenced_correlation), 6) AS differenced_median
FROM lags GROUP BY 1"""


@query("lag_summary", "A16", with_(DEMAND, _lags("demand")) + LAG_SUMMARY)
def lag_summary(spark, sf_dir):
    out = pr.lag_summary(full_demand(spark, sf_dir))
    return r(out, "median", "q25", "q75", "min", "max", "differenced_median")


@query("lag_summary_events", "A16", with_(EVENT, _lags("event")) + LAG_SUMMARY)
def lag_summary_events(spark, sf_dir):
    out = pr.lag_summary(event_panel(spark, sf_dir))
    return r(out, "median", "q25", "q75", "min", "max", "differenced_median")


DESCRIBE_SQL = """count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50, round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max"""
DESCRIBED = ("mean", "std", "min", "q25", "q50", "q75", "max")


@query(
    "promo_within_series",
    "A17",
    with_(PANEL)
    + """, d AS (SELECT SKU_ID, Warehouse_ID, avg(Units_Sold) FILTER (Promotion_Flag = 1) - avg(Units_Sold) FILTER (Promotion_Flag = 0) AS v FROM panel GROUP BY 1, 2)
SELECT 'promotion_minus_nonpromotion_mean' AS variable, """
    + DESCRIBE_SQL.format(v="v")
    + ", count(v) AS comparable_series, count(*) FILTER (v > 0) AS positive_differences FROM d",
)
def promo_within_series(spark, sf_dir):
    return r(pr.promotion_effect_summary(full_panel(spark, sf_dir)), *DESCRIBED)


@query(
    "total_reconciliation",
    "A18",
    with_(PANEL)
    + " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", (SELECT sum(t) FROM (SELECT sum(Units_Sold) AS t FROM panel GROUP BY {g}) AS q) = (SELECT sum(Units_Sold) FROM panel) AS passed"
        for n, g in (
            ("daily totals equal source", "Date"),
            ("monthly totals equal source", "strftime(Date, '%Y-%m')"),
            ("SKU totals equal source", "SKU_ID, strftime(Date, '%Y-%m')"),
            ("warehouse totals equal source", "Warehouse_ID, strftime(Date, '%Y-%m')"),
        )
    )
    + " UNION ALL SELECT 'promotion counts equal source', (SELECT sum(c) FROM (SELECT count(*) AS c FROM panel GROUP BY Promotion_Flag) AS q) = (SELECT count(*) FROM panel)",
)
def total_reconciliation(spark, sf_dir):
    return pr.total_reconciliation(full_panel(spark, sf_dir))


DAILY_SQL = """
dt AS (SELECT Date, count(*) AS rows, CAST(sum(Units_Sold) AS BIGINT) AS total, avg(Units_Sold) AS mean FROM demand GROUP BY 1),
days AS (SELECT *,
  CASE WHEN count(*) OVER (ORDER BY Date ROWS 6 PRECEDING) = 7 THEN avg(total) OVER (ORDER BY Date ROWS 6 PRECEDING) END AS rolling_mean_7,
  CASE WHEN count(*) OVER (ORDER BY Date ROWS 13 PRECEDING) = 14 THEN avg(total) OVER (ORDER BY Date ROWS 13 PRECEDING) END AS rolling_mean_14,
  total - lag(total) OVER (ORDER BY Date) AS change,
  (total / CAST(nullif(lag(total) OVER (ORDER BY Date), 0) AS DOUBLE) - 1) * 100 AS change_pct FROM dt)"""


@query(
    "daily_totals",
    "W8 W9",
    with_(DEMAND, DAILY_SQL)
    + "SELECT Date, rows, total, round(mean, 6) AS mean, round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_mean_14, 6) AS rolling_mean_14, change, round(change_pct, 6) AS change_pct FROM days",
)
def daily_totals(spark, sf_dir):
    return r(
        pr.daily_totals(full_demand(spark, sf_dir)),
        "mean",
        "rolling_mean_7",
        "rolling_mean_14",
        "change_pct",
    )


@query(
    "monthly_totals",
    "W10 A30",
    with_(DEMAND)
    + """, m AS (SELECT strftime(Date, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT Date) AS days, CAST(sum(Units_Sold) AS BIGINT) AS total,
  avg(Units_Sold) AS mean, max(day(last_day(Date))) AS calendar_days FROM demand GROUP BY 1)
SELECT month, rows, days, total, round(mean, 6) AS mean, calendar_days, round(total / CAST(days AS DOUBLE), 6) AS mean_daily_total,
round((total / CAST(nullif(lag(total) OVER (ORDER BY month), 0) AS DOUBLE) - 1) * 100, 6) AS total_change_pct,
round((mean / nullif(lag(mean) OVER (ORDER BY month), 0) - 1) * 100, 6) AS mean_change_pct FROM m""",
)
def monthly_totals(spark, sf_dir):
    return r(
        pr.monthly_totals(full_demand(spark, sf_dir)),
        "mean",
        "mean_daily_total",
        "total_change_pct",
        "mean_change_pct",
    )


@query(
    "diff_series",
    "W11",
    with_(GAP)
    + """SELECT t.SKU_ID, t.Warehouse_ID, t.Date, t.Units_Sold, t.Units_Sold - p.Units_Sold AS change FROM gap t
LEFT JOIN gap p ON p.SKU_ID = t.SKU_ID AND p.Warehouse_ID = t.Warehouse_ID AND p.Date = t.Date - 1""",
)
def diff_series(spark, sf_dir):
    return pr.first_differences(gap_panel(spark, sf_dir))


@query(
    "autocorr_lag1",
    "W12",
    with_(GAP)
    + """, l AS (SELECT *, lag(Units_Sold) OVER (PARTITION BY SKU_ID, Warehouse_ID ORDER BY Date) AS p FROM gap)
SELECT SKU_ID, Warehouse_ID, round(corr(Units_Sold, p), 6) AS lag1_autocorrelation FROM l GROUP BY 1, 2""",
)
def autocorr_lag1(spark, sf_dir):
    return r(pr.row_lag_autocorrelation(gap_panel(spark, sf_dir)), "lag1_autocorrelation")


@query(
    "extremes",
    "K1 U1",
    with_(DEMAND, DAILY_SQL)
    + """SELECT * FROM (SELECT Date, total, 'highest daily totals' AS kind FROM days ORDER BY total DESC, Date LIMIT 5) AS a
UNION ALL SELECT * FROM (SELECT Date, total, 'lowest daily totals' AS kind FROM days ORDER BY total, Date LIMIT 5) AS b""",
)
def extremes(spark, sf_dir):
    return pr.extremes(full_demand(spark, sf_dir))


@query(
    "largest_changes",
    "K2",
    with_(DEMAND, DAILY_SQL)
    + "SELECT Date, total, change, round(change_pct, 6) AS change_pct FROM days WHERE change IS NOT NULL ORDER BY abs(change) DESC, Date LIMIT 10",
)
def largest_changes(spark, sf_dir):
    return r(pr.largest_changes(full_demand(spark, sf_dir)), "change_pct")


@query(
    "data_driven_notes",
    "A31",
    with_(PANEL)
    + """, m AS (SELECT strftime(Date, '%Y-%m') AS month, avg(Units_Sold) AS mean FROM panel GROUP BY 1),
d AS (SELECT Date, CAST(sum(Units_Sold) AS BIGINT) AS total FROM panel GROUP BY 1),
h AS (SELECT month, mean FROM m ORDER BY mean DESC, month LIMIT 1), l AS (SELECT month, mean FROM m ORDER BY mean, month LIMIT 1),
pk AS (SELECT * FROM d ORDER BY total DESC, Date LIMIT 1), tr AS (SELECT * FROM d ORDER BY total, Date LIMIT 1),
p AS (SELECT avg(Units_Sold) FILTER (Promotion_Flag = 1) AS a, avg(Units_Sold) FILTER (Promotion_Flag = 0) AS b,
  count(*) FILTER (Units_Sold = 0) AS z, CAST(sum(Units_Sold) AS BIGINT) AS t FROM panel)
SELECT h.month AS highest_month, round(h.mean, 6) AS highest_month_mean, l.month AS lowest_month, round(l.mean, 6) AS lowest_month_mean,
round(h.mean / nullif(l.mean, 0), 6) AS month_ratio, pk.Date AS peak_day, pk.total AS peak_total, tr.Date AS trough_day, tr.total AS trough_total,
t AS total_units, round(a, 6) AS promotion_mean, round(b, 6) AS nonpromotion_mean, round(a - b, 6) AS promotion_difference, z AS zero_rows
FROM h, l, pk, tr, p""",
)
def data_driven_notes(spark, sf_dir):
    return r(
        pr.notes(full_panel(spark, sf_dir)),
        "highest_month_mean",
        "lowest_month_mean",
        "month_ratio",
        "promotion_mean",
        "nonpromotion_mean",
        "promotion_difference",
    )


@query(
    "peak_month_histogram",
    "A32",
    with_(DEMAND, _monthly("SKU_ID"))
    + """, b AS (SELECT e, month, row_number() OVER (PARTITION BY e ORDER BY mean DESC, month) AS k FROM mm)
SELECT month, count(*) AS entities_with_highest_mean FROM b WHERE k = 1 GROUP BY 1""",
)
def peak_month_histogram(spark, sf_dir):
    return pr.peak_month_histogram(full_demand(spark, sf_dir))


@query(
    "calendar_zero_facts",
    "A34",
    with_(DEMAND)
    + """, d AS (SELECT Date, count(*) AS n, count(*) FILTER (Units_Sold = 0) AS z FROM demand GROUP BY 1)
SELECT 'First observed day' AS measure, CAST(min(Date) AS VARCHAR) AS value FROM d
UNION ALL SELECT 'Last observed day', CAST(max(Date) AS VARCHAR) FROM d
UNION ALL SELECT 'Observed dates', CAST(count(*) AS VARCHAR) FROM d
UNION ALL SELECT 'Dates in calendar year', CAST(dayofyear(make_date(year(min(Date)), 12, 31)) AS VARCHAR) FROM d
UNION ALL SELECT 'Native rows per day: min', CAST(min(n) AS VARCHAR) FROM d
UNION ALL SELECT 'Native rows per day: max', CAST(max(n) AS VARCHAR) FROM d
UNION ALL SELECT 'Zero-demand rows', CAST(CAST(sum(z) AS BIGINT) AS VARCHAR) FROM d
UNION ALL SELECT 'Zero-demand share', printf('%.6f', sum(z) / CAST(sum(n) AS DOUBLE)) FROM d""",
)
def calendar_zero_facts(spark, sf_dir):
    return pr.calendar_facts(full_demand(spark, sf_dir))


def _describe_tables_sql():
    series = {
        "rows": "rows",
        "mean": "mean",
        "std": "std",
        "zero_share": "zs",
        "coefficient_of_variation": "std / nullif(mean, 0)",
    }
    longs = [f"SELECT 'series.{n}' AS variable, CAST({e} AS DOUBLE) AS value FROM sp" for n, e in series.items()]
    longs += [
        f"SELECT 'daily.{n}', CAST({n} AS DOUBLE) FROM days"
        for n in ("total", "mean", "rolling_mean_7", "rolling_mean_14")
    ]
    longs += [
        f"SELECT 'sku_variation.{n}', CAST({e} AS DOUBLE) FROM sv"
        for n, e in {
            "min_month_mean": "lo",
            "max_month_mean": "hi",
            "max_min_ratio": "hi / nullif(lo, 0)",
        }.items()
    ]
    return (
        with_(
            DEMAND,
            DAILY_SQL,
            _monthly("SKU_ID"),
            "sp AS (SELECT SKU_ID, Warehouse_ID, count(*) AS rows, avg(Units_Sold) AS mean, stddev_samp(Units_Sold) AS std, "
            "avg(CASE WHEN Units_Sold = 0 THEN 1.0 ELSE 0.0 END) AS zs FROM demand GROUP BY 1, 2)",
            "sv AS (SELECT e, min(mean) AS lo, max(mean) AS hi FROM mm GROUP BY 1)",
            "longs AS (" + " UNION ALL ".join(longs) + ")",
        )
        + f"SELECT variable, {DESCRIBE_SQL.format(v='value')} FROM longs GROUP BY 1"
    )


@query("describe_table", "A35", _describe_tables_sql())
def describe_table(spark, sf_dir):
    return r(pr.describe_tables(full_panel(spark, sf_dir)), *DESCRIBED)


DOCUMENTED = {
    "rows": "91250",
    "columns": "15",
    "dates": "365",
    "skus": "50",
    "warehouses": "5",
    "date_min": "2024-01-01",
    "date_max": "2024-12-30",
    "suppliers": "10",
    "regions": "4",
    "stockout_zero_rows": "91250",
    "nonzero_order_rows": "5027",
}


def _baseline_sql():
    observed = {
        "rows": "count(*)",
        "columns": "max(15)",
        "dates": "count(DISTINCT Date)",
        "skus": "count(DISTINCT SKU_ID)",
        "warehouses": "count(DISTINCT Warehouse_ID)",
        "date_min": "min(Date)",
        "date_max": "max(Date)",
        "suppliers": "count(DISTINCT Supplier_ID)",
        "regions": "count(DISTINCT Region)",
        "stockout_zero_rows": "count(*) FILTER (Stockout_Flag = 0)",
        "nonzero_order_rows": "count(*) FILTER (Order_Quantity > 0)",
    }
    blocks = " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", '{DOCUMENTED[n]}' AS documented, CAST({e} AS VARCHAR) AS observed FROM panel"
        for n, e in observed.items()
    )
    return with_(PANEL) + f"SELECT *, documented = observed AS matches FROM ({blocks}) AS t"


@query("dq_baseline_compare", "V12", _baseline_sql())
def dq_baseline_compare(spark, sf_dir):
    return pr.compare_with_documented(full_panel(spark, sf_dir), DOCUMENTED)
