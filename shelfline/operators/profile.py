"""Descriptive demand and inventory profiles.

Medians of demand within a series, a period or a place use ``percentile`` over
their days; statistics over all rows or over series use the binned exact quantiles.  Windows without a partition
key run only over tables already aggregated to one row per day or month, whose
length is bounded by the calendar.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.fixed import INVENTORY_COLUMNS, KEY, PROFILE_LAGS, SERIES
from shelfline.functions.expr import count_if, pearson, ratio, share, unpivot_named
from shelfline.functions.quantiles import column_medians, describe, exact_percentiles
from shelfline.sources.panels import day_no


def month_label(c: str = "Date") -> Column:
    return F.date_format(F.col(c), "yyyy-MM")


def quarter_label(c: str = "Date") -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def with_periods(panel: DataFrame) -> DataFrame:
    return panel.withColumn("month", month_label()).withColumn("quarter", quarter_label())


def summary_columns() -> list[Column]:
    units = F.col("Units_Sold")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("Date").alias("days"),
        F.sum(units).alias("total"),
        F.avg(units).alias("mean"),
        F.median(units).alias("median"),
        F.stddev_samp(units).alias("std"),
        share(units == 0).alias("zero_share"),
        F.avg(F.col("Promotion_Flag").cast("double")).alias("promotion_share"),
    ]


def summarize(panel: DataFrame, groups: list[str]) -> DataFrame:
    """The generic demand summary for one grouping."""
    return panel.groupBy(*groups).agg(*summary_columns())


def summarize_many(panel: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Several groupings from one pass over the panel (GROUPING SETS)."""
    columns = list(dict.fromkeys(c for names in sets.values() for c in names))
    which = F.when(F.lit(False), "")
    grouped = [[F.col(c) for c in names] for names in sets.values()]
    for label, names in sets.items():
        code = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in names)
        which = which.when(F.grouping_id(*columns) == code, label)
    return panel.groupingSets(grouped, *columns).agg(
        which.alias("grouping"), *summary_columns()
    ).select("grouping", *columns, "rows", "days", "total", "mean", "median", "std", "zero_share", "promotion_share")


DISTRIBUTION = {
    "1%": 0.01, "5%": 0.05, "25%": 0.25, "50%": 0.5, "75%": 0.75, "95%": 0.95, "99%": 0.99,
}


def distribution(panel: DataFrame) -> DataFrame:
    """describe() of native demand with seven percentiles, long form; no rows for no demand."""
    units = panel.select(F.lit("units").alias("variable"), "Units_Sold")
    names = {f"p{i}": p for i, p in enumerate(DISTRIBUTION.values())}
    wide = exact_percentiles(units, ["variable"], "Units_Sold", names, with_moments=True)
    pairs = [("count", F.col("count").cast("double")), *[(c, F.col(c).cast("double")) for c in ("mean", "std", "min")]]
    pairs += [(name, F.col(f"p{i}")) for i, name in enumerate(DISTRIBUTION)]
    pairs.append(("max", F.col("max").cast("double")))
    return unpivot_named(wide, pairs, "statistic", "value")


def series_profile(panel: DataFrame) -> DataFrame:
    """Per-series summary with coefficient of variation (mean 0 is undefined)."""
    return summarize(panel, SERIES).withColumn(
        "coefficient_of_variation", ratio(F.col("std"), F.col("mean"))
    )


# --- grains -----------------------------------------------------------------


def week_start(c: str = "Date") -> Column:
    return F.to_date(F.date_trunc("week", F.col(c)))


def _grain_keys(grain: str) -> list[Column]:
    if grain == "sku_day":
        return [F.col("SKU_ID"), F.lit(None).cast("string"), F.col("Date")]
    if grain == "sku_warehouse_day":
        return [F.col("SKU_ID"), F.col("Warehouse_ID"), F.col("Date")]
    if grain == "sku_week":
        return [F.col("SKU_ID"), F.lit(None).cast("string"), week_start()]
    raise ValueError(f"unknown grain {grain}")


def regrain(panel: DataFrame, *grains: str) -> DataFrame:
    """Demand totals at candidate grains as (analytical_unit, series, period), from one pass."""
    names = ["SKU_ID", "Warehouse_ID", "period"]
    keyed = F.array(
        *[
            F.struct(F.lit(g).alias("analytical_unit"), *[k.alias(n) for k, n in zip(_grain_keys(g), names)])
            for g in grains
        ]
    )
    return (
        panel.select(F.explode(keyed).alias("g"), "Units_Sold")
        .groupBy(*[F.col(f"g.{n}").alias(n) for n in ["analytical_unit", *names]])
        .agg(F.sum("Units_Sold").alias("demand"))
        .select(*names, "demand", "analytical_unit")
    )


GRAINS = ("sku_day", "sku_warehouse_day", "sku_week")


def series_by_grain(panel: DataFrame) -> DataFrame:
    """Per-series completeness, sparsity, variation and short-lag dependence."""
    rows = regrain(panel, *GRAINS)
    key = ["analytical_unit", *SERIES]
    before = F.lag("demand").over(Window.partitionBy(*key).orderBy("period"))
    step = F.when(F.col("analytical_unit") == "sku_week", 7).otherwise(1)
    stats = (
        rows.withColumn("_previous", before)
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n_observations"),
            F.avg("demand").alias("mean_demand"),
            F.stddev_samp("demand").alias("std_demand"),
            share(F.col("demand") == 0).alias("zero_demand_share"),
            pearson("demand", "_previous").alias("lag1_autocorrelation"),
            F.count("period").alias("_dates"),
            F.datediff(F.max("period"), F.min("period")).alias("_span"),
        )
    )
    expected = F.floor(F.col("_span") / step) + 1
    return stats.select(
        *key,
        "n_observations",
        "mean_demand",
        "zero_demand_share",
        ratio(F.col("std_demand"), F.col("mean_demand")).alias("coefficient_of_variation"),
        "lag1_autocorrelation",
        F.least(F.lit(1.0), F.col("_dates") / expected).alias("temporal_completeness"),
    )


def grain_comparison(panel: DataFrame) -> DataFrame:
    """Candidate grains side by side: medians over their series."""
    stats = series_by_grain(panel)
    medians = {
        "median_observations_per_series": "n_observations",
        "median_zero_demand_share": "zero_demand_share",
        "median_coefficient_of_variation": "coefficient_of_variation",
        "median_lag1_autocorrelation": "lag1_autocorrelation",
        "median_temporal_completeness": "temporal_completeness",
        "median_mean_demand": "mean_demand",
    }
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("statistic"), F.col(c).cast("double").alias("value"))
            for name, c in medians.items()
        ]
    )
    long = stats.select("analytical_unit", F.explode(entries).alias("e")).select(
        "analytical_unit", "e.*"
    )
    middle = (
        exact_percentiles(long, ["analytical_unit", "statistic"], "value", {"median": 0.5})
        .groupBy("analytical_unit")
        .pivot("statistic", list(medians))
        .agg(F.first("median"))
    )
    sizes = stats.groupBy("analytical_unit").agg(
        F.count(F.lit(1)).alias("n_series"), F.sum("n_observations").alias("n_rows")
    )
    return sizes.join(middle, "analytical_unit")


def source_constraints(panel: DataFrame) -> DataFrame:
    """Dataset facts in long form; presence of a column is itself a fact."""
    facts = [
        ("row_count", F.count(F.lit(1))),
        ("date_min", F.min("Date")),
        ("date_max", F.max("Date")),
        ("unique_dates", F.count_distinct("Date")),
        ("unique_skus", F.count_distinct("SKU_ID")),
        ("unique_warehouses", F.count_distinct("Warehouse_ID")),
    ]
    if "Stockout_Flag" in panel.columns:
        nulls = F.coalesce(F.max(F.col("Stockout_Flag").isNull().cast("int")), F.lit(0))
        facts += [
            ("stockout_flag_unique_values", F.count_distinct("Stockout_Flag") + nulls),
            ("stockout_flag_positive_rows", count_if(F.col("Stockout_Flag") == 1)),
        ]
    if "Order_Quantity" in panel.columns:
        facts.append(("nonzero_order_quantity_rows", count_if(F.col("Order_Quantity") > 0)))
    for c in ("Demand_Forecast", "Stockout_Flag"):
        if c in panel.columns:
            facts.append((f"{c}_present", F.max(F.lit(True))))
    wide = panel.agg(*[c.cast("string").alias(n) for n, c in facts])
    return unpivot_named(wide, [(n, F.col(n)) for n, _ in facts], "check", "value")


def _distinct_with_null(c: str) -> Column:
    """Distinct values where NULL is a value, without a distinct aggregate.

    Only zero / one / several matters for variation checks, which min, max and
    a null flag decide exactly.
    """
    several = F.min(c) < F.max(c)
    has_null = F.bool_or(F.col(c).isNull())
    return (
        F.when(F.count(c) == 0, 0).when(several, 2).otherwise(1)
        + F.when(has_null, 1).otherwise(0)
    )


def promotion_consistency(panel: DataFrame) -> DataFrame:
    """SKU-days whose warehouses disagree about the promotion flag."""
    per_day = panel.groupBy("Date", "SKU_ID").agg(
        _distinct_with_null("Promotion_Flag").alias("_values")
    )
    conflicts = F.count_if(F.col("_values") > 1)
    return per_day.agg(
        F.count(F.lit(1)).alias("sku_day_groups"),
        conflicts.alias("groups_with_conflicting_promotion_flag"),
        ratio(conflicts, F.count(F.lit(1))).alias("conflict_share"),
    )


def native_grain(panel: DataFrame) -> DataFrame:
    per_key = panel.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    duplicated = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
    wide = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("source_rows"),
        F.count(F.lit(1)).alias("unique_date_sku_warehouse_keys"),
        duplicated.alias("duplicate_rows_at_native_key"),
        (duplicated == 0).cast("long").alias("native_key_is_unique"),
    )
    return unpivot_named(wide, [(n, F.col(n)) for n in wide.columns], "check", "value")


def cross_warehouse_variation(panel: DataFrame) -> DataFrame:
    """Per inventory column: SKU-days whose warehouses differ."""
    per_day = panel.groupBy("Date", "SKU_ID").agg(
        *[_distinct_with_null(c).alias(c) for c in INVENTORY_COLUMNS]
    )
    wide = per_day.agg(
        F.count(F.lit(1)).alias("_groups"),
        *[F.count_if(F.col(c) > 1).alias(f"_v_{c}") for c in INVENTORY_COLUMNS],
        *[F.count_if(F.col(c) == 1).alias(f"_c_{c}") for c in INVENTORY_COLUMNS],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col("_groups").alias("sku_day_groups"),
                F.col(f"_v_{c}").alias("groups_with_cross_warehouse_variation"),
                F.col(f"_c_{c}").alias("groups_constant_across_warehouses"),
                ratio(F.col(f"_v_{c}"), F.col("_groups")).alias("variation_share"),
            )
            for c in INVENTORY_COLUMNS
        ]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def warehouse_coverage(panel: DataFrame) -> DataFrame:
    """Histogram of warehouses per SKU-day with shares."""
    counts = (
        panel.groupBy("Date", "SKU_ID")
        .agg(F.count_distinct("Warehouse_ID").alias("warehouses_per_sku_day"))
        .groupBy("warehouses_per_sku_day")
        .agg(F.count(F.lit(1)).alias("sku_day_groups"))
    )
    # one row per distinct warehouse count
    everything = F.sum("sku_day_groups").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("sku_day_groups") / everything)


def inventory_ranges(panel: DataFrame) -> DataFrame:
    wide = panel.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in INVENTORY_COLUMNS],
        *[F.avg(c).alias(f"avg_{c}") for c in INVENTORY_COLUMNS],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in INVENTORY_COLUMNS],
        *[share(F.col(c) == 0).alias(f"z_{c}") for c in INVENTORY_COLUMNS],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col(f"lo_{c}").alias("min"),
                F.col(f"avg_{c}").alias("mean"),
                F.col(f"hi_{c}").alias("max"),
                F.col(f"z_{c}").alias("zero_share"),
            )
            for c in INVENTORY_COLUMNS
        ]
    )
    rest = wide.select(F.explode(entries).alias("e")).select("e.*")
    medians = column_medians(panel, INVENTORY_COLUMNS, "variable")
    return rest.join(medians, "variable", "left").select("variable", "min", "median", "mean", "max", "zero_share")


# --- monthly shapes ---------------------------------------------------------


def monthly_means(panel: DataFrame, entity: str) -> DataFrame:
    return (
        panel.select(entity, month_label().alias("month"), "Units_Sold")
        .groupBy(entity, "month")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("Units_Sold").alias("total"),
            F.avg("Units_Sold").alias("mean"),
        )
    )


def profile_index(panel: DataFrame, entity: str) -> DataFrame:
    """Monthly mean relative to the entity's own overall mean."""
    w = Window.partitionBy(entity)  # months of one entity: calendar-bounded
    overall = F.sum("total").over(w) / F.sum("rows").over(w)
    return monthly_means(panel, entity).select(
        entity,
        "month",
        "rows",
        "total",
        "mean",
        ratio(F.col("mean"), overall).alias("mean_index"),
    )


def variation_ratio(panel: DataFrame, entity: str) -> DataFrame:
    return (
        monthly_means(panel, entity)
        .groupBy(entity)
        .agg(F.min("mean").alias("min_month_mean"), F.max("mean").alias("max_month_mean"))
        .withColumn("max_min_ratio", ratio(F.col("max_month_mean"), F.col("min_month_mean")))
    )


def pattern_similarity(panel: DataFrame, entity: str) -> DataFrame:
    """Count, mean and spread of all pairwise correlations of monthly profiles.

    With each profile standardised to unit length, a pair's correlation is the
    inner product of two vectors.  The sum over all pairs follows from the sum
    of the vectors, and the sum of squares from their Gram matrix over months,
    so the work is linear in the number of entities and no pair is formed.
    Profiles must cover every month; others have no defined correlation here.
    """
    months = monthly_means(panel, entity)
    w = Window.partitionBy(entity)
    centred = months.select(
        entity,
        "month",
        (F.col("mean") - F.avg("mean").over(w)).alias("_c"),
        F.count(F.lit(1)).over(w).alias("_months"),
    )
    length = F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(w))
    unit = centred.select(
        entity, "month", "_months", (F.col("_c") / F.nullif(length, F.lit(0.0))).alias("_z")
    )
    profile = unit.groupBy(entity).agg(
        F.max("_months").alias("_months"),
        F.count("_z").alias("_defined"),
        F.collect_list(F.struct("month", "_z")).alias("_p"),  # one entry per month
    )
    longest = profile.agg(F.max("_months").alias("m")).scalar()
    usable = profile.where((F.col("_months") == longest) & (F.col("_defined") == longest))
    gram = (
        usable.select(F.explode("_p").alias("a"), "_p")
        .select("a", F.explode("_p").alias("b"))
        .groupBy(F.col("a.month").alias("ma"), F.col("b.month").alias("mb"))
        .agg(F.sum(F.col("a._z") * F.col("b._z")).alias("g"))
    )
    sums = (
        usable.select(F.explode("_p").alias("a"))
        .groupBy("a.month")
        .agg(F.sum("a._z").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    first = sums.agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("n"))
    second = gram.agg(F.sum(F.col("g") * F.col("g")).alias("g2")).scalar()
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    total = (F.col("s2") - n) / 2
    squares = (second - n) / 2
    mean = total / F.nullif(pairs, F.lit(0.0))
    spread = (squares - pairs * mean * mean) / F.nullif(pairs - 1, F.lit(0.0))
    return first.select(
        pairs.cast("long").alias("pairs"),
        mean.alias("mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"),
    )


def peak_month_histogram(panel: DataFrame, entity: str = "SKU_ID") -> DataFrame:
    """How many entities have their highest monthly mean in each month."""
    best = (
        monthly_means(panel, entity)
        .groupBy(entity)
        .agg(F.min(F.struct((-F.col("mean")).alias("m"), F.col("month"))).alias("_b"))
    )
    return best.groupBy(F.col("_b.month").alias("month")).agg(
        F.count(F.lit(1)).alias("entities_with_highest_mean")
    )


# --- lag dependence ---------------------------------------------------------


def lag_correlation(panel: DataFrame) -> DataFrame:
    """Per series and lag: correlation with calendar-lagged demand.

    Levels and first differences; a gap in the calendar is a missing value.
    All lags share one window pass and one per-series aggregate.
    """
    w = Window.partitionBy(*SERIES).orderBy("_day")
    base = panel.select(*SERIES, F.col("Units_Sold").cast("double").alias("u0"), day_no().alias("_day"))
    offsets = sorted({k for lag in PROFILE_LAGS for k in (lag, lag + 1)} | {1})
    shifted = base.select(
        *SERIES,
        "u0",
        *[F.max("u0").over(w.rangeBetween(-k, -k)).alias(f"u{k}") for k in offsets],
    )
    change = F.col("u0") - F.col("u1")
    pairs = []
    for lag in PROFILE_LAGS:
        pairs.append(pearson("u0", f"u{lag}", at_least=3).alias(f"level_{lag}"))
        earlier = F.col(f"u{lag}") - F.col(f"u{lag + 1}")
        pairs.append(pearson(change, earlier, at_least=3).alias(f"diff_{lag}"))
    wide = shifted.groupBy(*SERIES).agg(*pairs)
    entries = F.array(
        *[
            F.struct(
                F.lit(lag).alias("lag_days"),
                F.col(f"level_{lag}").alias("correlation"),
                F.col(f"diff_{lag}").alias("differenced_correlation"),
            )
            for lag in PROFILE_LAGS
        ]
    )
    return wide.select(*SERIES, F.explode(entries).alias("e")).select(*SERIES, "e.*")


def lag_summary(panel: DataFrame) -> DataFrame:
    lags = lag_correlation(panel)
    entries = F.array(
        F.struct(F.lit("level").alias("kind"), F.col("correlation").alias("value")),
        F.struct(F.lit("diff").alias("kind"), F.col("differenced_correlation").alias("value")),
    )
    long = lags.select("lag_days", F.explode(entries).alias("e")).select("lag_days", "e.*")
    stats = describe(long, ["lag_days", "kind"], "value")
    level, differenced = F.col("kind") == "level", F.col("kind") == "diff"
    # lags without any defined correlation keep a row with a zero count
    roster = F.explode(F.array(*[F.lit(lag) for lag in PROFILE_LAGS])).alias("lag_days")
    known = lags.limit(1).select(roster)
    return (
        known.join(stats, "lag_days", "left")
        .groupBy("lag_days")
        .agg(
            F.coalesce(F.max(F.when(level, F.col("count"))), F.lit(0)).alias("defined_series"),
            F.max(F.when(level, F.col("q50"))).alias("median"),
            F.max(F.when(level, F.col("q25"))).alias("q25"),
            F.max(F.when(level, F.col("q75"))).alias("q75"),
            F.max(F.when(level, F.col("min"))).alias("min"),
            F.max(F.when(level, F.col("max"))).alias("max"),
            F.max(F.when(differenced, F.col("q50"))).alias("differenced_median"),
        )
    )


def first_differences(panel: DataFrame) -> DataFrame:
    """Day-over-day change inside a series; undefined across a calendar gap."""
    w = Window.partitionBy(*SERIES).orderBy("_day").rangeBetween(-1, -1)
    return panel.select(*SERIES, "Date", "Units_Sold", day_no().alias("_day")).select(
        *SERIES,
        "Date",
        "Units_Sold",
        (F.col("Units_Sold") - F.max("Units_Sold").over(w)).alias("change"),
    )


def row_lag_autocorrelation(panel: DataFrame) -> DataFrame:
    """Pearson with the previous observed row (not the previous day)."""
    before = F.lag("Units_Sold").over(Window.partitionBy(*SERIES).orderBy("Date"))
    return (
        panel.select(*SERIES, "Units_Sold", before.alias("_previous"))
        .groupBy(*SERIES)
        .agg(pearson("Units_Sold", "_previous").alias("lag1_autocorrelation"))
    )


# --- daily and monthly tables -----------------------------------------------


def daily_totals(panel: DataFrame) -> DataFrame:
    """One row per day with trailing means (display day included) and changes."""
    by_day = panel.groupBy("Date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("Units_Sold").alias("total"),
        F.avg("Units_Sold").alias("mean"),
    )
    w = Window.orderBy("Date")  # one row per calendar day
    columns = []
    for size in (7, 14):
        frame = w.rowsBetween(-(size - 1), 0)
        columns.append(
            F.when(F.count("total").over(frame) == size, F.avg("total").over(frame)).alias(
                f"rolling_mean_{size}"
            )
        )
    before = F.lag("total").over(w)
    return by_day.select(
        "Date",
        "rows",
        "total",
        "mean",
        *columns,
        (F.col("total") - before).alias("change"),
        ((ratio(F.col("total"), before) - 1) * 100).alias("change_pct"),
    )


def monthly_totals(panel: DataFrame) -> DataFrame:
    by_month = panel.withColumn("month", month_label()).groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("Date").alias("days"),
        F.sum("Units_Sold").alias("total"),
        F.avg("Units_Sold").alias("mean"),
        F.max(F.day(F.last_day("Date"))).alias("calendar_days"),
    )
    w = Window.orderBy("month")  # one row per month

    def change(c: str) -> Column:
        return ((ratio(F.col(c), F.lag(c).over(w)) - 1) * 100).alias(f"{c}_change_pct")

    return by_month.select(
        "*",
        (F.col("total") / F.col("days")).alias("mean_daily_total"),
        change("total"),
        change("mean"),
    )


def extremes(panel: DataFrame, n: int = 5) -> DataFrame:
    """The n highest and n lowest days; ties go to the earliest date."""
    days = panel.groupBy("Date").agg(F.sum("Units_Sold").alias("total"))
    top = days.orderBy(F.desc("total"), "Date").limit(n)
    low = days.orderBy("total", "Date").limit(n)
    return top.withColumn("kind", F.lit("highest daily totals")).unionByName(
        low.withColumn("kind", F.lit("lowest daily totals"))
    )


def largest_changes(panel: DataFrame, n: int = 10) -> DataFrame:
    return (
        daily_totals(panel)
        .where(F.col("change").isNotNull())
        .orderBy(F.desc(F.abs("change")), "Date")
        .limit(n)
        .orderBy("Date")
        .select("Date", "total", "change", "change_pct")
    )


def promotion_effect(panel: DataFrame) -> DataFrame:
    """Per series: mean on promotion days minus mean on the others."""
    flag = F.col("Promotion_Flag")
    return panel.groupBy(*SERIES).agg(
        (
            F.avg(F.when(flag == 1, F.col("Units_Sold")))
            - F.avg(F.when(flag == 0, F.col("Units_Sold")))
        ).alias("promotion_minus_nonpromotion_mean")
    )


def promotion_effect_summary(panel: DataFrame) -> DataFrame:
    value = "promotion_minus_nonpromotion_mean"
    effect = promotion_effect(panel).withColumn("variable", F.lit(value))
    counts = effect.groupBy("variable").agg(
        F.count(value).alias("comparable_series"),
        F.count_if(F.coalesce(F.col(value) > 0, F.lit(False))).alias("positive_differences"),
    )
    return counts.join(describe(effect, ["variable"], value), "variable", "left")


def total_reconciliation(panel: DataFrame) -> DataFrame:
    """Every roll-up returns the source total; all roll-ups come from one pass (GROUPING SETS)."""
    rollups = {
        "daily totals equal source": ["Date"],
        "monthly totals equal source": ["month"],
        "SKU totals equal source": ["SKU_ID", "month"],
        "warehouse totals equal source": ["Warehouse_ID", "month"],
        "promotion counts equal source": ["Promotion_Flag"],
        "source": [],
    }
    columns = ["Date", "month", *SERIES, "Promotion_Flag"]
    which = F.lit(None).cast("string")
    for name, keys in rollups.items():
        code = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        which = F.when(F.grouping_id(*columns) == code, name).otherwise(which)
    rolled = (
        panel.select(*[c for c in columns if c != "month"], month_label().alias("month"), "Units_Sold")
        .groupingSets([[F.col(c) for c in keys] for keys in rollups.values()], *columns)
        .agg(which.alias("check"), F.sum("Units_Sold").alias("total"), F.count(F.lit(1)).alias("rows"))
    )
    sums = rolled.groupBy("check").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    source = F.max(F.when(F.col("check") == "source", F.struct("total", "rows")))
    everything = Window.partitionBy(F.lit(0))  # six rows
    passed = F.when(F.col("check") == "promotion counts equal source", F.col("rows") == F.col("_s.rows")).otherwise(
        F.col("total") == F.col("_s.total")
    )
    return (
        sums.withColumn("_s", source.over(everything))
        .where("check != 'source'")
        .select("check", passed.alias("passed"))
    )


def notes(panel: DataFrame) -> DataFrame:
    """The numbers behind the narrative: peaks, troughs and ratios, one row."""
    months = monthly_totals(panel)
    days = panel.groupBy("Date").agg(F.sum("Units_Sold").alias("total"))

    def first_by(c: str, key: str, descending: bool) -> Column:
        rank = -F.col(c) if descending else F.col(c)
        return F.min(F.struct(rank.alias("r"), F.col(key).alias("k"), F.col(c).alias("v")))

    m = months.agg(
        first_by("mean", "month", True).alias("hi"), first_by("mean", "month", False).alias("lo")
    )
    d = days.agg(
        first_by("total", "Date", True).alias("peak"),
        first_by("total", "Date", False).alias("trough"),
        F.sum("total").alias("total_units"),
    )
    flag = F.col("Promotion_Flag")
    p = panel.agg(
        F.avg(F.when(flag == 1, F.col("Units_Sold"))).alias("promotion_mean"),
        F.avg(F.when(flag == 0, F.col("Units_Sold"))).alias("nonpromotion_mean"),
        F.count_if(F.col("Units_Sold") == 0).alias("zero_rows"),
    )
    # three one-row relations side by side
    one = F.lit(1).alias("_1")
    return (
        m.select(
            one,
            F.col("hi.k").alias("highest_month"),
            F.col("hi.v").alias("highest_month_mean"),
            F.col("lo.k").alias("lowest_month"),
            F.col("lo.v").alias("lowest_month_mean"),
            ratio(F.col("hi.v"), F.col("lo.v")).alias("month_ratio"),
        )
        .join(
            d.select(
                one,
                F.col("peak.k").alias("peak_day"),
                F.col("peak.v").alias("peak_total"),
                F.col("trough.k").alias("trough_day"),
                F.col("trough.v").alias("trough_total"),
                "total_units",
            ),
            "_1",
        )
        .join(
            p.select(
                one,
                "promotion_mean",
                "nonpromotion_mean",
                (F.col("promotion_mean") - F.col("nonpromotion_mean")).alias("promotion_difference"),
                "zero_rows",
            ),
            "_1",
        )
        .drop("_1")
    )


def calendar_facts(panel: DataFrame) -> DataFrame:
    """Temporal completeness and zero-demand facts, long form."""
    per_day = panel.groupBy("Date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("Units_Sold") == 0).alias("zeros")
    )
    year_end = F.make_date(F.year(F.min("Date")), F.lit(12), F.lit(31))
    wide = per_day.agg(
        F.min("Date").cast("string").alias("First observed day"),
        F.max("Date").cast("string").alias("Last observed day"),
        F.count(F.lit(1)).cast("string").alias("Observed dates"),
        F.dayofyear(year_end).cast("string").alias("Dates in calendar year"),
        F.min("rows").cast("string").alias("Native rows per day: min"),
        F.max("rows").cast("string").alias("Native rows per day: max"),
        F.sum("zeros").cast("string").alias("Zero-demand rows"),
        F.format_string("%.6f", ratio(F.sum("zeros"), F.sum("rows"))).alias("Zero-demand share"),
    )
    return unpivot_named(
        wide, [(n, F.col(f"`{n}`")) for n in wide.columns], "measure", "value"
    )


def describe_tables(panel: DataFrame) -> DataFrame:
    """describe() of the derived per-series, per-day and per-entity columns."""
    def long(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
        entries = F.array(
            *[
                F.struct(
                    F.lit(f"{prefix}.{n}").alias("variable"), F.col(n).cast("double").alias("value")
                )
                for n in names
            ]
        )
        return df.select(F.explode(entries).alias("e")).select("e.*")

    rows = long(
        series_profile(panel),
        "series",
        ["rows", "mean", "std", "zero_share", "coefficient_of_variation"],
    ).unionByName(
        long(daily_totals(panel), "daily", ["total", "mean", "rolling_mean_7", "rolling_mean_14"])
    ).unionByName(
        long(
            variation_ratio(panel, "SKU_ID"),
            "sku_variation",
            ["min_month_mean", "max_month_mean", "max_min_ratio"],
        )
    )
    return describe(rows, ["variable"], "value")


def baseline_facts(panel: DataFrame) -> DataFrame:
    """The observed side of the historical comparison, long form."""
    wide = panel.agg(
        F.count(F.lit(1)).cast("string").alias("rows"),
        F.lit(str(len(panel.columns))).alias("columns"),
        F.count_distinct("Date").cast("string").alias("dates"),
        F.count_distinct("SKU_ID").cast("string").alias("skus"),
        F.count_distinct("Warehouse_ID").cast("string").alias("warehouses"),
        F.min("Date").cast("string").alias("date_min"),
        F.max("Date").cast("string").alias("date_max"),
        F.count_distinct("Supplier_ID").cast("string").alias("suppliers"),
        F.count_distinct("Region").cast("string").alias("regions"),
        F.count_if(F.col("Stockout_Flag") == 0).cast("string").alias("stockout_zero_rows"),
        F.count_if(F.col("Order_Quantity") > 0).cast("string").alias("nonzero_order_rows"),
    )
    return unpivot_named(wide, [(n, F.col(n)) for n in wide.columns], "check", "observed")


def compare_with_documented(panel: DataFrame, documented: dict[str, str]) -> DataFrame:
    """Observed facts against documented ones; context, never a cleaning rule."""
    expected = F.lit(None).cast("string")
    for name, value in documented.items():
        expected = F.when(F.col("check") == name, F.lit(value)).otherwise(expected)
    return baseline_facts(panel).select(
        "check",
        expected.alias("documented"),
        "observed",
        F.coalesce(expected == F.col("observed"), F.lit(False)).alias("matches"),
    )
