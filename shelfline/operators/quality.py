"""Counted data-quality checks over source text.  Nothing is ever repaired.

All scalar checks of one table come from a single aggregate pass.  Duplicate
and continuity checks are two-level hash aggregates, so a hot key is combined
map-side instead of being gathered in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import (
    COUNTS,
    FLAGS,
    IDENTIFIERS,
    KEY,
    MONEY,
    NUMERIC,
    PANEL_COLUMNS,
    SERIES,
)
from shelfline.functions.expr import (
    INF,
    blank,
    clean_text,
    finite_or_null,
    number,
    strict_date,
    unpivot_named,
)
from shelfline.functions.grids import crossed
from shelfline.functions.quantiles import column_medians


class SourceDefects(ValueError):
    """Raised when a source may not be published."""


def check_schema(df: DataFrame, columns: list[str] = PANEL_COLUMNS) -> list[str]:
    """Schema problems of a source relation; empty when it is acceptable."""
    problems = []
    if len(df.columns) != len(set(df.columns)):
        problems.append("duplicate_columns")
    if set(df.columns) != set(columns):
        problems.append("column_set_differs")
    elif df.isEmpty():
        problems.append("empty_scope")
    return problems


def parse(raw: DataFrame) -> DataFrame:
    """Typed representation; values that do not parse are missing."""
    typed = {"Date": strict_date("Date"), **{c: number(c) for c in NUMERIC}}
    return raw.select(*[typed.get(c, F.col(c)).alias(c) for c in PANEL_COLUMNS])


def typed_panel(raw: DataFrame) -> DataFrame:
    """Final column types of an accepted source."""
    kinds = {**dict.fromkeys(COUNTS, "long"), **dict.fromkeys(FLAGS, "int")}
    parsed = parse(raw)
    return parsed.select(
        *[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in PANEL_COLUMNS]
    )


def _scalar_checks() -> list[tuple[str, Column]]:
    def counted(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def total(conditions: list[Column]) -> Column:
        per_row = F.lit(0)
        for c in conditions:
            per_row = per_row + F.when(c, 1).otherwise(0)
        return F.coalesce(F.sum(per_row), F.lit(0)).cast("long")

    checks = [
        ("missing_cells", total([F.col(c).isNull() for c in PANEL_COLUMNS])),
        (
            "blank_cells",
            total([blank(c) for c in PANEL_COLUMNS]),
        ),
    ]
    checks += [(f"{c}_invalid_identifier", counted(~clean_text(c))) for c in IDENTIFIERS]
    for c in NUMERIC:
        raw, value = F.col(c), number(c)
        unlimited = F.abs(value) == F.lit(INF)
        checks.append((f"{c}_invalid_numeric", counted(raw.isNotNull() & value.isNull())))
        checks.append((f"{c}_infinite", counted(unlimited)))
        if c in COUNTS + MONEY:
            checks.append((f"{c}_negative", counted(value < 0)))
        if c in COUNTS:
            fraction = F.when(~unlimited, value) % 1 != 0
            checks.append((f"{c}_fractional", counted(fraction)))
        if c in FLAGS:
            checks.append((f"{c}_not_binary", counted(~value.isin(0.0, 1.0))))
    checks.append(("invalid_dates", counted(strict_date("Date").isNull())))
    checks.append(("non_midnight_dates", counted(F.lit(False))))
    return checks


def scalar_checks(raw: DataFrame) -> DataFrame:
    """All per-cell checks as (check, affected), one pass over the source."""
    checks = _scalar_checks()
    wide = raw.agg(*[c.alias(name) for name, c in checks])
    return unpivot_named(wide, [(n, F.col(n)) for n, _ in checks], "check", "affected")


def raw_variants(raw: DataFrame) -> DataFrame:
    """Distinct source rows among repeated native keys, with multiplicity.

    Only the narrow key is shuffled for the whole table; full rows travel just
    for the keys that turned out to be repeated.
    """
    keyed = raw.withColumn("_key_date", strict_date("Date"))
    key = ["_key_date", *SERIES]
    repeated = (
        keyed.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1")
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
    )
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & keyed[c].eqNullSafe(repeated[f"_k{i}"])
    return (
        keyed.join(repeated, same, "left_semi")
        .groupBy(*PANEL_COLUMNS, "_key_date")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def duplicate_keys(raw: DataFrame) -> DataFrame:
    """Repeated native keys: rows, distinct payloads and exact copies."""
    return (
        raw_variants(raw)
        .groupBy(F.col("_key_date").alias("Date"), *SERIES)
        .agg(
            F.sum("copies").alias("key_rows"),
            F.count(F.lit(1)).alias("payloads"),
            F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("exact_rows"),
        )
        .where("key_rows > 1")
        .withColumn("conflicting", F.col("payloads") > 1)
    )


def duplicate_checks(raw: DataFrame) -> DataFrame:
    """Counts of every member of duplicate groups, as (check, affected)."""
    repeated = duplicate_keys(raw)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    wide = repeated.agg(
        total(F.col("exact_rows")).alias("exact_duplicate_rows"),
        total(F.col("key_rows")).alias("duplicate_native_key_rows"),
        total(F.when(F.col("conflicting"), F.col("key_rows")).otherwise(0)).alias(
            "conflicting_native_key_rows"
        ),
    )
    names = ["exact_duplicate_rows", "duplicate_native_key_rows", "conflicting_native_key_rows"]
    return unpivot_named(wide, [(n, F.col(n)) for n in names], "check", "affected")


def observed_days(keyed: DataFrame, bad: Column | None = None) -> DataFrame:
    """Distinct days per series, by two map-side-combined aggregates."""
    flag = F.lit(False) if bad is None else bad
    return (
        keyed.groupBy(*SERIES, "Date")
        .agg(F.bool_or(flag).alias("_bad"))
        .groupBy(*SERIES)
        .agg(
            F.count("Date").alias("observed_days"),
            F.min("Date").alias("_lo"),
            F.max("Date").alias("_hi"),
            F.bool_or("_bad").alias("_bad"),
        )
    )


def usable_series() -> Column:
    return (
        F.col("SKU_ID").isNotNull()
        & F.col("Warehouse_ID").isNotNull()
        & (F.col("observed_days") > 0)
    )


def continuity_gap(keyed: DataFrame, bad: Column | None = None) -> DataFrame:
    """Missing series-days over the crossed roster, as one number.

    Absent pairs count fully.  The total is |SKU| x |warehouse| x span minus
    the observed series-days, so the crossed roster never has to exist.  While
    any row is flagged ``bad`` the roster is undefined and the count is 0.
    """
    ok = usable_series()
    facts = observed_days(keyed, bad).agg(
        F.count_distinct(F.when(ok, F.col("SKU_ID"))).alias("skus"),
        F.count_distinct(F.when(ok, F.col("Warehouse_ID"))).alias("warehouses"),
        (F.datediff(F.max(F.when(ok, F.col("_hi"))), F.min(F.when(ok, F.col("_lo")))) + 1)
        .cast("long")
        .alias("span"),
        F.sum(F.when(ok, F.col("observed_days"))).alias("observed"),
        F.bool_or("_bad").alias("bad"),
    )
    total = F.col("skus") * F.col("warehouses") * F.col("span") - F.col("observed")
    return facts.select(
        F.coalesce(F.when(~F.col("bad"), total), F.lit(0))
        .cast("long")
        .alias("missing_series_days_in_observed_span")
    )


def validation_checks(raw: DataFrame) -> DataFrame:
    """Every check of the audit as (check, affected)."""
    bad_identifier = F.lit(False)
    for c in IDENTIFIERS:
        bad_identifier = bad_identifier | ~clean_text(c)
    gaps = continuity_gap(parse(raw), bad_identifier).select(
        F.lit("missing_series_days_in_observed_span").alias("check"),
        F.col("missing_series_days_in_observed_span").alias("affected"),
    )
    return scalar_checks(raw).unionByName(duplicate_checks(raw)).unionByName(gaps)


def audit_facts(raw: DataFrame) -> DataFrame:
    """Row counts, distinct values (null is a value) and finite ranges."""
    parsed = parse(raw)
    distinct = [
        (F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)))
        .cast("double")
        .alias(f"distinct_{c}")
        for c in PANEL_COLUMNS
    ]
    ranges = []
    for c in NUMERIC:
        value = finite_or_null(c)
        ranges += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
    return parsed.agg(F.count(F.lit(1)).cast("double").alias("input_rows"), *distinct, *ranges)


def fact_table(raw: DataFrame) -> DataFrame:
    """`audit_facts` in long form plus the number of distinct native keys."""
    wide = audit_facts(raw)
    long = unpivot_named(wide, [(n, F.col(n)) for n in wide.columns], "fact", "value")
    keys = parse(raw).select(*KEY).distinct().agg(F.count(F.lit(1)).cast("double").alias("value"))
    return long.unionByName(keys.select(F.lit("unique_native_keys").alias("fact"), "value"))


def audit_status(checks: DataFrame) -> DataFrame:
    """passed only when no check has an affected row."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("affected") > 0).alias("failed_checks"),
        F.when(F.max("affected") > 0, "failed").otherwise("passed").alias("status"),
    )


def require_valid(raw: DataFrame) -> DataFrame:
    """Checks of an accepted source; raises with the failing ones otherwise."""
    problems = check_schema(raw)
    if problems:
        raise SourceDefects("; ".join(problems))
    checks = validation_checks(raw)
    # at most one row per check name: bounded by the check list
    failed = {r["check"]: r["affected"] for r in checks.where("affected > 0").collect()}
    if failed:
        raise SourceDefects(f"blocking source defects: {failed}")
    return checks


def missingness(panel: DataFrame) -> DataFrame:
    wide = panel.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in PANEL_COLUMNS],
        *[
            F.count_if(blank(c)).alias(
                f"b_{c}"
            )
            for c in PANEL_COLUMNS
        ],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m_{c}").alias("missing"),
                F.col(f"b_{c}").alias("blank"),
            )
            for c in PANEL_COLUMNS
        ]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def coverage(panel: DataFrame) -> DataFrame:
    """Observed against expected days for every crossed (SKU, warehouse) pair."""
    per_series = observed_days(panel).where(usable_series())
    span = per_series.agg(
        (F.datediff(F.max("_hi"), F.min("_lo")) + 1).cast("long").alias("days")
    ).scalar()
    roster = crossed(per_series.select("SKU_ID"), per_series.select("Warehouse_ID"))
    observed = F.coalesce(F.col("observed_days"), F.lit(0).cast("long"))
    return roster.join(per_series, SERIES, "left").select(
        *SERIES,
        observed.alias("observed_days"),
        span.alias("expected_days_in_observed_span"),
        (span - observed).alias("missing_days"),
        (observed / span).alias("completeness"),
    )


def numeric_ranges(panel: DataFrame) -> DataFrame:
    """min, max, mean and exact median of every numeric column."""
    wide = panel.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in NUMERIC],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in NUMERIC],
        *[F.avg(c).alias(f"avg_{c}") for c in NUMERIC],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"lo_{c}").alias("min"),
                F.col(f"hi_{c}").alias("max"),
                F.col(f"avg_{c}").alias("mean"),
            )
            for c in NUMERIC
        ]
    )
    rest = wide.select(F.explode(entries).alias("e")).select("e.*")
    return rest.join(column_medians(panel, NUMERIC, "column"), "column", "left")


def demand_contract(
    rows: DataFrame, *, require_daily: bool = True, history_end=None
) -> DataFrame:
    """Contract of a demand view as (check, affected).

    Quantities after ``history_end`` are masked before they are checked, so a
    post-origin value can never influence the outcome.
    """
    from pyspark.sql import Window

    day = strict_date("Date") if dict(rows.dtypes)["Date"] == "string" else F.col("Date")
    view = rows.select(*SERIES, day.alias("Date"), F.col("Units_Sold").alias("_raw"))
    if history_end is not None:
        view = view.withColumn("_raw", F.when(F.col("Date") <= F.lit(history_end), F.col("_raw")))
    value = number("_raw")
    present = F.col("_raw").isNotNull()
    bad_units = present & (
        value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(INF)) | (value < 0) | (value % 1 != 0)
    )
    cells = view.agg(
        *[
            F.count_if(~clean_text(c)).alias(f"{c}_invalid_identifier") for c in SERIES
        ],
        F.count_if(F.col("Date").isNull()).alias("invalid_dates"),
        F.count_if(F.coalesce(bad_units, F.lit(True))).alias("invalid_observed_units"),
    )
    per_day = view.groupBy(*SERIES, "Date").agg(F.count(F.lit(1)).alias("copies"))
    before = F.lag("Date").over(Window.partitionBy(*SERIES).orderBy("Date"))
    keys = per_day.withColumn("_gap", F.datediff("Date", before) != 1).agg(
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias(
            "duplicate_key_rows"
        ),
        F.count_if(F.coalesce(F.col("_gap"), F.lit(False)) & F.lit(require_daily)).alias(
            "non_daily_gaps"
        ),
    )
    left = unpivot_named(cells, [(n, F.col(n)) for n in cells.columns], "check", "affected")
    right = unpivot_named(keys, [(n, F.col(n)) for n in keys.columns], "check", "affected")
    return left.unionByName(right)


def gap_positions(panel: DataFrame) -> DataFrame:
    """Rows whose previous observation is not the day before."""
    from pyspark.sql import Window

    before = F.lag("Date").over(Window.partitionBy(*SERIES).orderBy("Date"))
    return (
        panel.select(*SERIES, "Date", before.alias("previous_date"))
        .withColumn("gap_days", F.datediff("Date", "previous_date") - 1)
        .where("gap_days > 0")
    )


def roster_gaps(panel: DataFrame) -> DataFrame:
    """Crossed pairs that have no series at all."""
    roster = panel.select(*SERIES).distinct()
    return crossed(roster.select("SKU_ID"), roster.select("Warehouse_ID")).join(
        roster, SERIES, "left_anti"
    )


def roster_gaps_by_key(panel: DataFrame) -> DataFrame:
    """Crossed pairs that have no series at all, with how many warehouses the SKU has and lacks.

    Only SKUs that lack a warehouse are crossed, so the result is no longer than SKUs x
    warehouses.  Nulls are values like any other.
    """
    present = panel.select(*SERIES).distinct()
    warehouses = present.select("Warehouse_ID").distinct()
    n = warehouses.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = present.groupBy("SKU_ID").agg(F.count(F.lit(1)).alias("present"))
    lacking = counts.withColumn("absent", n - F.col("present")).where("absent > 0")
    found = present.alias("p")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in SERIES]
    return crossed(lacking, warehouses).alias("w").join(found, same, "left_anti").select(*SERIES, "present", "absent")


def reserved_rows(panel: DataFrame, holdout_start) -> DataFrame:
    """Count of rows that may not enter preparation."""
    return panel.agg(
        F.count_if(F.col("Date") >= F.lit(holdout_start)).alias("reserved_rows"),
        F.when(F.max("Date") >= F.lit(holdout_start), "blocked").otherwise("clear").alias("status"),
    )
