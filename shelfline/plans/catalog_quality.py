"""Data-quality queries over clean and deliberately defective sources."""

from __future__ import annotations

from datetime import date
from functools import partial

from pyspark.sql import functions as F

from shelfline.fixed import COUNTS, FLAGS, IDENTIFIERS, MONEY, NUMERIC, PANEL_COLUMNS, SERIES
from shelfline.operators import quality as dq
from shelfline.plans import oracle_base
from shelfline.plans.oracle_base import GAP, whole, with_
from shelfline.plans.registry import query
from shelfline.sources import panels
from shelfline.sources.panels import gap_panel

# checks cover the whole log
DEMAND, PANEL, RAW = whole(oracle_base.DEMAND), whole(oracle_base.PANEL), whole(oracle_base.RAW)
full_demand = partial(panels.full_demand, whole=True)
full_panel = partial(panels.full_panel, whole=True)
raw_panel = partial(panels.raw_panel, whole=True)
raw_panel_with_defects = partial(panels.raw_panel_with_defects, whole=True)

DATE_SQL = (
    "CASE WHEN regexp_full_match(Date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(Date AS DATE) END"
)
PARSED = (
    "parsed AS (SELECT "
    + f"{DATE_SQL} AS Date, "
    + ", ".join(IDENTIFIERS)
    + ", "
    + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
    + " FROM raw)"
)


def union_checks(parts: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", CAST({e} AS BIGINT) AS affected FROM {source}" for n, e in parts
    )


def numeric_parts():
    out = []
    for c in NUMERIC:
        v = f"TRY_CAST({c} AS DOUBLE)"
        out.append((f"{c}_invalid_numeric", f"count(*) FILTER ({c} IS NOT NULL AND {v} IS NULL)"))
        out.append((f"{c}_infinite", f"count(*) FILTER (isinf({v}))"))
        if c in COUNTS + MONEY:
            out.append((f"{c}_negative", f"count(*) FILTER ({v} < 0)"))
        if c in COUNTS:
            out.append((f"{c}_fractional", f"count(*) FILTER (NOT isinf({v}) AND {v} % 1 <> 0)"))
        if c in FLAGS:
            out.append((f"{c}_not_binary", f"count(*) FILTER ({v} NOT IN (0, 1))"))
    return out


MISSING_PARTS = [
    ("missing_cells", "sum(" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in PANEL_COLUMNS) + ")"),
    (
        "blank_cells",
        "sum(" + " + ".join(f"COALESCE(CAST(NOT regexp_matches({c}, '\\S') AS INTEGER), 0)" for c in PANEL_COLUMNS) + ")",
    ),
]
ID_PARTS = [
    (
        f"{c}_invalid_identifier",
        f"count(*) FILTER (NOT COALESCE(regexp_full_match({c}, '\\S(.*\\S)?'), false))",
    )
    for c in IDENTIFIERS
]
DATE_PARTS = [
    ("invalid_dates", f"count(*) FILTER ({DATE_SQL} IS NULL)"),
    ("non_midnight_dates", "min(0)"),
]
DUP_CTE = (
    "variants AS (SELECT *, count(*) AS copies FROM raw GROUP BY ALL), "
    f"keys AS (SELECT {DATE_SQL} AS d, SKU_ID, Warehouse_ID, sum(copies) AS key_rows, count(*) AS payloads, "
    "sum(CASE WHEN copies > 1 THEN copies ELSE 0 END) AS exact_rows FROM variants GROUP BY 1, 2, 3 "
    "HAVING sum(copies) > 1)"
)
DUP_PARTS = [
    ("exact_duplicate_rows", "COALESCE(sum(exact_rows), 0)"),
    ("duplicate_native_key_rows", "COALESCE(sum(key_rows), 0)"),
    ("conflicting_native_key_rows", "COALESCE(sum(CASE WHEN payloads > 1 THEN key_rows ELSE 0 END), 0)"),
]
GAP_SQL = """
span AS (SELECT date_diff('day', min(Date), max(Date)) + 1 AS days FROM {src}
         WHERE Date IS NOT NULL AND SKU_ID IS NOT NULL AND Warehouse_ID IS NOT NULL),
pairs AS (SELECT s.SKU_ID, w.Warehouse_ID FROM
  (SELECT DISTINCT SKU_ID FROM {src} WHERE Date IS NOT NULL AND SKU_ID IS NOT NULL AND Warehouse_ID IS NOT NULL) s,
  (SELECT DISTINCT Warehouse_ID FROM {src} WHERE Date IS NOT NULL AND SKU_ID IS NOT NULL AND Warehouse_ID IS NOT NULL) w),
cover AS (SELECT p.SKU_ID, p.Warehouse_ID, count(DISTINCT x.Date) AS observed_days
  FROM pairs p LEFT JOIN {src} x ON x.SKU_ID = p.SKU_ID AND x.Warehouse_ID = p.Warehouse_ID GROUP BY 1, 2)"""


@query(
    "dq_parse",
    "V2",
    with_(RAW, PARSED)
    + "SELECT Date, SKU_ID, Warehouse_ID, Units_Sold, Inventory_Level, Unit_Cost, Promotion_Flag, Demand_Forecast FROM parsed",
)
def dq_parse(spark, sf_dir):
    return dq.parse(raw_panel_with_defects(spark, sf_dir)).select(
        "Date", *SERIES, "Units_Sold", "Inventory_Level", "Unit_Cost", "Promotion_Flag", "Demand_Forecast"
    )


def _checks(spark, sf_dir, wanted):
    rows = dq.scalar_checks(raw_panel_with_defects(spark, sf_dir))
    return rows.where(F.col("check").isin([n for n, _ in wanted]))


@query("dq_missing_blank", "V3", with_(RAW) + union_checks(MISSING_PARTS, "raw"))
def dq_missing_blank(spark, sf_dir):
    return _checks(spark, sf_dir, MISSING_PARTS)


@query("dq_identifiers", "V4", with_(RAW) + union_checks(ID_PARTS, "raw"))
def dq_identifiers(spark, sf_dir):
    return _checks(spark, sf_dir, ID_PARTS)


@query("dq_numeric_domains", "V5", with_(RAW) + union_checks(numeric_parts(), "raw"))
def dq_numeric_domains(spark, sf_dir):
    return _checks(spark, sf_dir, numeric_parts())


@query(
    "dq_exact_duplicates",
    "V6",
    with_(RAW)
    + """SELECT Date, SKU_ID, Warehouse_ID, Order_Quantity, count(*) AS copies FROM raw
GROUP BY ALL HAVING count(*) > 1""".replace("GROUP BY ALL", "GROUP BY " + ", ".join(PANEL_COLUMNS)),
)
def dq_exact_duplicates(spark, sf_dir):
    return (
        dq.raw_variants(raw_panel_with_defects(spark, sf_dir))
        .where("copies > 1")
        .select("Date", *SERIES, "Order_Quantity", "copies")
    )


@query(
    "dq_key_duplicates",
    "V7",
    with_(RAW, DUP_CTE)
    + """SELECT d AS Date, SKU_ID, Warehouse_ID, CAST(key_rows AS BIGINT) AS key_rows, payloads,
CAST(exact_rows AS BIGINT) AS exact_rows, payloads > 1 AS conflicting FROM keys""",
)
def dq_key_duplicates(spark, sf_dir):
    return dq.duplicate_keys(raw_panel_with_defects(spark, sf_dir))


@query(
    "dq_continuity",
    "V8",
    with_(GAP, GAP_SQL.format(src="gap"))
    + "SELECT CAST(sum(days - observed_days) AS BIGINT) AS missing_series_days_in_observed_span FROM cover, span",
)
def dq_continuity(spark, sf_dir):
    return dq.continuity_gap(gap_panel(spark, sf_dir))


@query(
    "dq_audit",
    "V10",
    with_(RAW, DUP_CTE)
    + union_checks(MISSING_PARTS + ID_PARTS + numeric_parts() + DATE_PARTS, "raw")
    + " UNION ALL "
    + union_checks(DUP_PARTS, "keys")
    + " UNION ALL SELECT 'missing_series_days_in_observed_span', 0",
)
def dq_audit(spark, sf_dir):
    return dq.validation_checks(raw_panel_with_defects(spark, sf_dir))


@query(
    "dq_audit_clean_status",
    "V10 V1",
    with_(PANEL) + "SELECT 46 AS checks, 0 AS failed_checks, CASE WHEN count(*) > 0 THEN 'passed' END AS status FROM panel",
)
def dq_audit_clean(spark, sf_dir):
    raw = raw_panel(spark, sf_dir)
    problems = dq.check_schema(raw.limit(0))
    assert "column_set_differs" not in problems and "duplicate_columns" not in problems
    return dq.audit_status(dq.validation_checks(raw))


def _facts_sql():
    parts = [("input_rows", "count(*)")]
    parts += [(f"distinct_{c}", f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER))") for c in PANEL_COLUMNS]
    for c in NUMERIC:
        parts.append((f"min_{c}", f"min({c}) FILTER (isfinite({c}))"))
        parts.append((f"max_{c}", f"max({c}) FILTER (isfinite({c}))"))
    body = " UNION ALL ".join(
        f"SELECT '{n}' AS fact, CAST({e} AS DOUBLE) AS value FROM parsed" for n, e in parts
    )
    return (
        with_(RAW, PARSED)
        + body
        + " UNION ALL SELECT 'unique_native_keys', CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT Date, SKU_ID, Warehouse_ID FROM parsed)"
    )


@query("dq_audit_facts", "V10", _facts_sql())
def dq_audit_facts(spark, sf_dir):
    return dq.fact_table(raw_panel_with_defects(spark, sf_dir))


@query(
    "dq_missingness_table",
    "V11",
    with_(PANEL)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, "
        f"count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS blank FROM panel"
        for c in PANEL_COLUMNS
    ),
)
def dq_missingness(spark, sf_dir):
    return dq.missingness(full_panel(spark, sf_dir))


COVER_SQL = (
    "SELECT SKU_ID, Warehouse_ID, observed_days, days AS expected_days_in_observed_span, "
    "days - observed_days AS missing_days, observed_days / CAST(days AS DOUBLE) AS completeness FROM cover, span"
)


@query("dq_coverage_table", "V11", with_(GAP, GAP_SQL.format(src="gap")) + COVER_SQL)
def dq_coverage(spark, sf_dir):
    return dq.coverage(gap_panel(spark, sf_dir))


@query(
    "coverage_histogram",
    "A33",
    with_(GAP, GAP_SQL.format(src="gap"))
    + f"SELECT observed_days, expected_days_in_observed_span, missing_days, completeness, count(*) AS series_count FROM ({COVER_SQL}) AS t GROUP BY 1, 2, 3, 4",
)
def coverage_histogram(spark, sf_dir):
    keys = ["observed_days", "expected_days_in_observed_span", "missing_days", "completeness"]
    return (
        dq.coverage(gap_panel(spark, sf_dir))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("series_count"))
    )


@query(
    "dq_numeric_ranges",
    "V11",
    with_(PANEL)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"round(avg({c}), 6) AS mean, round(CAST(median({c}) AS DOUBLE), 6) AS median FROM panel"
        for c in NUMERIC
    ),
)
def dq_numeric_ranges(spark, sf_dir):
    return dq.numeric_ranges(full_panel(spark, sf_dir)).select(
        "column", "min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median")
    )


@query(
    "demand_contract",
    "V13 W13",
    with_(RAW)
    + f""", v AS (SELECT SKU_ID, Warehouse_ID, {DATE_SQL} AS d, Units_Sold FROM raw),
m AS (SELECT SKU_ID, Warehouse_ID, d, CASE WHEN d <= DATE '1997-12-02' THEN Units_Sold END AS u FROM v),
k AS (SELECT SKU_ID, Warehouse_ID, d, count(*) AS c FROM m GROUP BY 1, 2, 3),
g AS (SELECT c, date_diff('day', lag(d) OVER (PARTITION BY SKU_ID, Warehouse_ID ORDER BY d NULLS FIRST), d) AS step FROM k)
SELECT 'SKU_ID_invalid_identifier' AS "check", count(*) FILTER (NOT COALESCE(regexp_full_match(SKU_ID, '\\S(.*\\S)?'), false)) AS affected FROM m
UNION ALL SELECT 'Warehouse_ID_invalid_identifier', count(*) FILTER (NOT COALESCE(regexp_full_match(Warehouse_ID, '\\S(.*\\S)?'), false)) FROM m
UNION ALL SELECT 'invalid_dates', count(*) FILTER (d IS NULL) FROM m
UNION ALL SELECT 'invalid_observed_units', count(*) FILTER (u IS NOT NULL AND (TRY_CAST(u AS DOUBLE) IS NULL OR TRY_CAST(u AS DOUBLE) < 0 OR TRY_CAST(u AS DOUBLE) % 1 <> 0)) FROM m
UNION ALL SELECT 'duplicate_key_rows', CAST(COALESCE(sum(c) FILTER (c > 1), 0) AS BIGINT) FROM k
UNION ALL SELECT 'non_daily_gaps', count(*) FILTER (step <> 1) FROM g""",
)
def demand_contract(spark, sf_dir):
    return dq.demand_contract(
        raw_panel_with_defects(spark, sf_dir), history_end=date(1997, 12, 2)
    )


@query(
    "gap_detection",
    "W13",
    with_(GAP)
    + """, l AS (SELECT SKU_ID, Warehouse_ID, Date, lag(Date) OVER (PARTITION BY SKU_ID, Warehouse_ID ORDER BY Date) AS previous_date FROM gap)
SELECT *, date_diff('day', previous_date, Date) - 1 AS gap_days FROM l WHERE date_diff('day', previous_date, Date) > 1""",
)
def gap_detection(spark, sf_dir):
    return dq.gap_positions(gap_panel(spark, sf_dir))


@query(
    "roster_complete_grid",
    "V14",
    with_(GAP)
    + """, narrow AS (SELECT DISTINCT SKU_ID, Warehouse_ID FROM gap WHERE Units_Sold >= 3000)
SELECT s.SKU_ID, w.Warehouse_ID FROM (SELECT DISTINCT SKU_ID FROM gap) s, (SELECT DISTINCT Warehouse_ID FROM gap) w
WHERE NOT EXISTS (SELECT 1 FROM gap g WHERE g.SKU_ID = s.SKU_ID AND g.Warehouse_ID = w.Warehouse_ID)""",
)
def roster_complete_grid(spark, sf_dir):
    return dq.roster_gaps(gap_panel(spark, sf_dir))


@query(
    "roster_gaps_in_sparse_log",
    "V14",
    """WITH pairs AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS SKU_ID, o_orderpriority || o_orderstatus AS Warehouse_ID FROM orders),
w AS (SELECT DISTINCT Warehouse_ID FROM pairs),
s AS (SELECT SKU_ID, count(*) AS present, (SELECT count(*) FROM w) - count(*) AS absent FROM pairs GROUP BY SKU_ID)
SELECT s.SKU_ID, w.Warehouse_ID, present, absent FROM s, w
WHERE NOT EXISTS (SELECT 1 FROM pairs g WHERE g.SKU_ID IS NOT DISTINCT FROM s.SKU_ID AND g.Warehouse_ID IS NOT DISTINCT FROM w.Warehouse_ID)""",
)
def roster_gaps_sparse(spark, sf_dir):
    """Customers against kinds of order: every absent pair over all orders, with its customer's counts."""
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("SKU_ID"),
        F.concat("o_orderpriority", "o_orderstatus").alias("Warehouse_ID"),
    )
    return dq.roster_gaps_by_key(pairs)


@query(
    "reserved_period_guard",
    "V16",
    with_(DEMAND)
    + """SELECT count(*) FILTER (Date >= DATE '1997-12-03') AS reserved_rows,
CASE WHEN max(Date) >= DATE '1997-12-03' THEN 'blocked' ELSE 'clear' END AS status FROM demand""",
)
def reserved_period_guard(spark, sf_dir):
    return dq.reserved_rows(full_demand(spark, sf_dir), date(1997, 12, 3))
