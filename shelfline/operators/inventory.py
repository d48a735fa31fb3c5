"""Forecast x inventory preparation and reorder-threshold exposure.

Every status and reason is a CASE expression, so a row of any shape passes
through one code-generated projection.  Rows are never dropped or repaired:
an unusable cell yields a status with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import EVALUABLE_HORIZONS, GROUP_FIELDS, HORIZONS, RATES
from shelfline.functions.expr import all_of, any_of, clean_text, finite, number, ratio, strict_date

# fixed values: method approval statuses and required input columns
METHOD_STATUS = "group_approved"
LEGACY_METHOD_STATUS = "proposed_for_group_approval"

REQUIRED_COLUMNS = [
    "SKU_ID",
    "Warehouse_ID",
    "forecast_origin",
    "horizon",
    "target_start_date",
    "target_end_date",
    "prediction",
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "model",
    "configuration_id",
    "Date",
    "Inventory_Level",
    "Reorder_Point",
]
PROVENANCE_COLUMNS = ["run_id", "evaluation_stage", "evidence_role", "model", "configuration_id"]
CASE_KEY = ["SKU_ID", "Warehouse_ID", "forecast_origin", "horizon"]


@dataclass(frozen=True)
class Disclosure:
    """Texts that travel with every row; callers may supply their own."""

    assumptions: tuple[str, ...] = (
        "Balances count only when their availability at the origin is established.",
        "The reorder point stays fixed and nothing is received during the horizon.",
        "Transfers, returns, losses and other adjustments are not modelled.",
        "Sold units stand in for demand and are read only after the forecast.",
    )
    limitations: tuple[str, ...] = (
        "Approval covers the scenario method, not stockout accuracy or operations.",
        "The stockout flag is not ground truth; the source forecast is not an input.",
        "Order quantity is context only and never a confirmed receipt.",
        "A negative scenario balance is arithmetic, not physical stock.",
        "The 28-day horizon needs a separate approval for inventory use.",
    )
    scenario_limitation: str = (
        "Starting balances are hypothetical; the scenario does not establish their availability."
    )


def missing_columns(records: DataFrame) -> list[str]:
    return sorted(set(REQUIRED_COLUMNS) - set(records.columns))


def identity_defects(records: DataFrame) -> DataFrame:
    """Blocking identity problems as (check, affected)."""
    names = ["SKU_ID", "Warehouse_ID", *PROVENANCE_COLUMNS]
    key = [*PROVENANCE_COLUMNS, *CASE_KEY]
    if "fold_id" in records.columns:
        key.append("fold_id")
    cells = records.agg(*[F.count_if(~clean_text(c)).alias(f"{c}_invalid_identifier") for c in names])
    duplicates = (
        records.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n"))
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("affected")) for c in cells.columns]
    )
    return (
        cells.select(F.explode(entries).alias("e"))
        .select("e.*")
        .unionByName(
            duplicates.select(F.lit("duplicate_forecast_records").alias("check"), F.col("n").alias("affected"))
        )
    )


# --- cell parsing -----------------------------------------------------------


def calendar_date(df: DataFrame, name: str) -> Column:
    """A calendar date; numbers, bad text and times of day become NULL."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind == "date":
        return c
    if kind.startswith("timestamp"):
        return F.when(c == F.date_trunc("day", c), F.to_date(c))
    return strict_date(c) if kind == "string" else F.lit(None).cast("date")


def finite_number(df: DataFrame, name: str) -> Column:
    """A finite number as double; only text is parsed, numeric columns are taken as they are."""
    kind = dict(df.dtypes)[name]
    if kind == "boolean":
        return F.lit(None).cast("double")
    value = number(name) if kind == "string" else F.col(name).cast("double")
    return F.when(finite(value), value)


def valid_count(df: DataFrame, name: str) -> Column:
    value = finite_number(df, name)
    return F.when((value >= 0) & (value % 1 == 0), value)


def horizon_days(df: DataFrame) -> Column:
    value = finite_number(df, "horizon")
    return F.when(value.isin(*[float(h) for h in HORIZONS]), value.cast("int"))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def parse_cells(records: DataFrame) -> DataFrame:
    """Parsed companions of the source cells; the originals stay untouched."""
    observed = (
        valid_count(records, "observed_target")
        if "observed_target" in records.columns
        else F.lit(None).cast("double")
    )
    return records.withColumns(
        {
            "_origin": calendar_date(records, "forecast_origin"),
            "_record": calendar_date(records, "Date"),
            "_start": calendar_date(records, "target_start_date"),
            "_end": calendar_date(records, "target_end_date"),
            "_horizon": horizon_days(records),
            "_demand": finite_number(records, "prediction"),
            "_level": valid_count(records, "Inventory_Level"),
            "_reorder": valid_count(records, "Reorder_Point"),
            "_observed": observed,
            "origin_snapshot_available": _optional(records, "origin_snapshot_available", "boolean"),
            "origin_snapshot_unavailable_reason": _optional(
                records, "origin_snapshot_unavailable_reason", "string"
            ),
        }
    )


# --- statuses ---------------------------------------------------------------


def snapshot_status() -> tuple[Column, Column]:
    marker = F.col("origin_snapshot_available")
    given = F.col("origin_snapshot_unavailable_reason")
    undated = F.col("_origin").isNull() | F.col("_record").isNull()
    status = (
        F.when(marker.isNull(), "unknown")
        .when(~marker | undated | (F.col("_record") != F.col("_origin")), "unavailable")
        .otherwise("available")
    )
    reason = (
        F.when(marker.isNull(), "origin_snapshot_availability_not_established")
        .when(
            ~marker,
            F.when(F.trim(given) != "", given).otherwise(
                "origin_snapshot_not_available_at_forecast_origin"
            ),
        )
        .when(undated, "invalid_origin_or_inventory_record_date")
        .when(
            F.col("_record") != F.col("_origin"),
            "inventory_record_date_does_not_match_forecast_origin",
        )
        .otherwise("")
    )
    return status, reason


def downstream_gate() -> tuple[Column, Column]:
    h = F.col("_horizon")
    status = (
        F.when(h == 28, "not_approved_for_downstream_use")
        .when(h.isin(*EVALUABLE_HORIZONS), "approved_method")
        .otherwise("unavailable")
    )
    reason = (
        F.when(h == 28, "28_day_downstream_use_requires_separate_approval")
        .when(h.isin(*EVALUABLE_HORIZONS), "")
        .otherwise("unsupported_or_invalid_forecast_horizon")
    )
    return status, reason


def interval_reasons() -> list[Column]:
    h, origin = F.col("_horizon"), F.col("_origin")
    fits = (F.col("_start") == F.date_add(origin, 1)) & (F.col("_end") == F.date_add(origin, h))
    return [
        F.when(h.isNull(), "unsupported_or_invalid_forecast_horizon"),
        F.when(origin.isNull(), "forecast_origin_missing_or_invalid").when(
            h.isNotNull() & ~F.coalesce(fits, F.lit(False)),
            "forecast_target_interval_does_not_match_origin_and_horizon",
        ),
    ]


def _status_reason(df: DataFrame, name: str, good: str, missing: str, wrong: str) -> Column:
    if name not in df.columns:
        return F.lit(missing)
    return F.when(~F.coalesce(F.col(name) == good, F.lit(False)), wrong)


def forecast_reasons(df: DataFrame) -> list[Column]:
    value = F.col("_demand")
    return [
        *interval_reasons(),
        F.when(value.isNull(), "forecast_missing_or_nonfinite").when(
            value < 0, "negative_forecast_handling_not_approved"
        ),
        _status_reason(
            df,
            "prediction_status",
            "available",
            "forecast_prediction_status_not_provided",
            "forecast_prediction_status_not_available",
        ),
        _status_reason(
            df,
            "eligibility_status",
            "eligible",
            "forecast_eligibility_status_not_provided",
            "forecast_eligibility_status_not_eligible",
        ),
        F.when(
            any_of(~clean_text(c) for c in PROVENANCE_COLUMNS), "forecast_provenance_incomplete"
        ),
    ]


def retrospective_reasons(df: DataFrame) -> list[Column]:
    return [
        *interval_reasons(),
        F.when(F.col("_observed").isNull(), "realised_horizon_demand_unavailable"),
        _status_reason(
            df,
            "target_status",
            "complete",
            "retrospective_target_status_not_provided",
            "retrospective_target_status_not_complete",
        ),
    ]


CONTEXT = (
    ("Supplier_Lead_Time_Days", "supplier_lead_time_available_at_origin", "lead_time_context_status"),
    ("Order_Quantity", "order_quantity_available_at_origin", "order_quantity_context_status"),
)


def context_status(df: DataFrame, value: str, marker: str) -> tuple[Column, Column]:
    """Context columns are usable only with their own availability marker."""
    if value not in df.columns:
        return F.lit("unavailable"), F.lit(f"{value}_not_provided")
    unestablished = f"{value}_availability_at_origin_not_established"
    if marker not in df.columns:
        return F.lit("unknown"), F.lit(unestablished)
    m = F.col(marker)
    if dict(df.dtypes)[marker] != "boolean":
        bad = F.when(m.isNull(), unestablished).otherwise(f"{value}_availability_marker_invalid")
        return F.lit("unknown"), bad
    snapshot = F.col("origin_snapshot_status") == "available"
    usable = valid_count(df, value).isNotNull()
    status = (
        F.when(m.isNull(), "unknown")
        .when(m & snapshot & usable, "available_as_context_only")
        .otherwise("unavailable")
    )
    reason = (
        F.when(m.isNull(), unestablished)
        .when(~m, f"{value}_not_available_at_origin")
        .when(~snapshot, f"{value}_origin_record_not_available")
        .when(~usable, f"{value}_missing_or_invalid")
    )
    return status, reason


def _compact(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items))


def prepare(records: DataFrame, disclosure: Disclosure = Disclosure()) -> DataFrame:
    """Statuses and reasons of every row; columns that are absent change them."""
    absent = missing_columns(records)
    if absent:
        raise ValueError("missing required columns: " + ", ".join(absent))
    cells = parse_cells(records)
    snap_status, snap_reason = snapshot_status()
    gate_status, gate_reason = downstream_gate()
    staged = cells.withColumns(
        {
            "methodology_status": F.lit(METHOD_STATUS),
            "origin_snapshot_status": snap_status,
            "origin_snapshot_reason": snap_reason,
            "downstream_use_status": gate_status,
            "downstream_use_reason": gate_reason,
            "_forecast_reasons": _compact(forecast_reasons(records)),
            "_retrospective_reasons": _compact(retrospective_reasons(records)),
            "method_assumptions": F.array(*[F.lit(t) for t in disclosure.assumptions]),
            "method_limitations": F.array(*[F.lit(t) for t in disclosure.limitations]),
        }
    )
    available = F.col("origin_snapshot_status") == "available"
    contexts = {name: context_status(records, value, marker) for value, marker, name in CONTEXT}
    supplied = (
        F.filter(
            F.coalesce(
                F.col("unavailable_information_reasons"), F.array().cast("array<string>")
            ),
            lambda t: F.trim(t) != "",
        )
        if "unavailable_information_reasons" in records.columns
        else F.array().cast("array<string>")
    )
    inventory = _compact(
        [
            F.when(~available, F.col("origin_snapshot_reason")),
            F.when(F.col("_level").isNull(), "inventory_level_missing_or_invalid"),
            F.when(F.col("_reorder").isNull(), "reorder_point_missing_or_invalid"),
        ]
    )
    no_reason = F.array().cast("array<string>")
    return staged.withColumns(
        {
            "inventory_state_available": available
            & F.col("_level").isNotNull()
            & F.col("_reorder").isNotNull(),
            "forecast_input_status": F.when(
                F.size("_forecast_reasons") == 0, "available"
            ).otherwise("unavailable"),
            "forecast_input_reason": F.array_join("_forecast_reasons", ";"),
            "retrospective_input_status": F.when(
                F.size("_retrospective_reasons") == 0, "available"
            ).otherwise("unavailable"),
            "retrospective_input_reason": F.array_join("_retrospective_reasons", ";"),
            **{name: status for name, (status, _) in contexts.items()},
            "preparation_unavailable_reasons": F.array_distinct(
                F.concat(
                    supplied,
                    inventory,
                    "_forecast_reasons",
                    "_retrospective_reasons",
                    F.coalesce(_compact([reason for _, reason in contexts.values()]), no_reason),
                )
            ),
            "lead_time_horizon_relation": _lead_time_relation(records, contexts),
        }
    ).drop("_forecast_reasons", "_retrospective_reasons")


def _lead_time_relation(records: DataFrame, contexts: dict) -> Column:
    if "Supplier_Lead_Time_Days" not in records.columns:
        return F.lit(None).cast("string")
    usable = contexts["lead_time_context_status"][0] == "available_as_context_only"
    lead, h = valid_count(records, "Supplier_Lead_Time_Days"), F.col("_horizon")
    return F.when(
        usable & h.isNotNull(),
        F.when(h < lead, "horizon_shorter_than_lead_time")
        .when(h == lead, "horizon_equal_to_lead_time")
        .otherwise("horizon_longer_than_lead_time"),
    )


# --- exposure ---------------------------------------------------------------


def exposure_cases(
    prepared: DataFrame,
    scenario_basis: str | None = None,
    disclosure: Disclosure = Disclosure(),
) -> DataFrame:
    """Threshold states, margins and the paired comparison cell of each row.

    With ``scenario_basis`` same-date balances become hypothetical starting
    balances; source markers and statuses keep their values.
    """
    if scenario_basis is not None and not scenario_basis.strip():
        raise ValueError("a constructed scenario needs a nonblank basis")
    scenario = scenario_basis is not None
    same_day = F.coalesce(
        (F.col("_origin") == F.col("_record"))
        & F.col("_level").isNotNull()
        & F.col("_reorder").isNotNull(),
        F.lit(False),
    )
    usable = same_day if scenario else F.col("inventory_state_available")
    prefix = "scenario_" if scenario else ""
    base = prepared.withColumns(
        {
            "inventory_basis": F.lit(
                "constructed_origin_scenario" if scenario else "source_availability"
            ),
            "snapshot_assumption": F.lit(scenario_basis).cast("string"),
            "scenario_inventory_state_available": same_day if scenario else F.lit(False),
            "analysis_inventory_state_available": usable,
            "inventory_buffer": F.when(usable, F.col("_level") - F.col("_reorder")),
        }
    )
    if scenario:
        base = base.withColumns(
            {
                "method_assumptions": F.concat(
                    F.slice("method_assumptions", 2, len(disclosure.assumptions)),
                    F.array(F.lit(scenario_basis)),
                ),
                "method_limitations": F.concat(
                    "method_limitations", F.array(F.lit(disclosure.scenario_limitation))
                ),
            }
        )
    buffer, h = F.col("inventory_buffer"), F.col("_horizon")
    below, above = buffer <= 0, buffer > 0
    evaluable = F.coalesce(h.isin(*EVALUABLE_HORIZONS), F.lit(False))
    forecast_ready = above & evaluable & (F.col("forecast_input_status") == "available")
    actual_ready = above & evaluable & (F.col("retrospective_input_status") == "available")
    crossing = F.col("_demand") >= buffer
    realised = F.col("_observed") >= buffer
    paired = forecast_ready & actual_ready
    cell = (
        F.when(crossing & realised, "TP")
        .when(~crossing & ~realised, "TN")
        .when(realised, "FN")
        .otherwise("FP")
    )
    return base.withColumns(
        {
            "origin_exposure_state": F.when(below, f"{prefix}already_at_or_below_threshold")
            .when(above, f"{prefix}initially_above_threshold")
            .otherwise("unavailable"),
            "forecast_exposure_state": F.when(
                below,
                "not_needed_scenario_origin_state"
                if scenario
                else "not_needed_origin_state_known",
            )
            .when(forecast_ready & crossing, "forecast_crossing")
            .when(forecast_ready, "no_forecast_crossing")
            .otherwise("unavailable"),
            "retrospective_exposure_state": F.when(below, "not_in_primary_comparison")
            .when(actual_ready & realised, "realised_crossing")
            .when(actual_ready, "no_realised_crossing")
            .otherwise("unavailable"),
            "predicted_margin": F.when(forecast_ready, buffer - F.col("_demand")),
            "retrospective_margin": F.when(actual_ready, buffer - F.col("_observed")),
            "comparison_case": F.when(
                below,
                "scenario_at_or_below_threshold"
                if scenario
                else "origin_known_at_or_below_threshold",
            )
            .when(paired, "evaluable_paired_case")
            .otherwise("unavailable"),
            "confusion_cell": F.when(paired, cell),
            "evaluation_unavailable_reasons": _evaluation_reasons(
                scenario, usable, below, forecast_ready, actual_ready
            ),
        }
    )


def _evaluation_reasons(scenario, usable, below, forecast_ready, actual_ready) -> Column:
    empty = F.array().cast("array<string>")
    gated = F.coalesce(F.col("_horizon") == 28, F.lit(False))

    def side(reason: str, fallback: str) -> Column:
        text = F.when(gated, F.col("downstream_use_reason")).when(
            F.col(reason) != "", F.col(reason)
        )
        return F.split(F.coalesce(text, F.lit(fallback)), ";")

    no_inventory = F.concat(
        F.array(F.lit("scenario_origin_snapshot_missing_or_invalid")) if scenario else empty,
        F.col("preparation_unavailable_reasons"),
        F.array(F.col("origin_snapshot_reason")),
    )
    no_pair = F.concat(
        F.when(
            ~F.coalesce(forecast_ready, F.lit(False)),
            side("forecast_input_reason", "forecast_exposure_not_assessed"),
        ).otherwise(empty),
        F.when(
            ~F.coalesce(actual_ready, F.lit(False)),
            side("retrospective_input_reason", "retrospective_exposure_not_assessed"),
        ).otherwise(empty),
    )
    chosen = F.when(~usable, no_inventory).when(below, empty).otherwise(no_pair)
    return F.array_distinct(F.filter(chosen, lambda t: F.trim(t) != ""))


def confusion_summary(cases: DataFrame) -> DataFrame:
    """Counts and rates per origin, horizon and candidate; never pooled."""
    fields = [c for c in GROUP_FIELDS if c in cases.columns]
    cell, case = F.col("confusion_cell"), F.col("comparison_case")
    above = F.col("origin_exposure_state").isin(
        "initially_above_threshold", "scenario_initially_above_threshold"
    )
    outside = ~F.coalesce(F.col("_horizon").isin(*EVALUABLE_HORIZONS), F.lit(False))

    def gated(status: str) -> Column:
        return F.count_if(above & ((F.col(status) != "available") | outside))

    counts = cases.groupBy(*fields).agg(
        *[F.count_if(F.coalesce(cell == c, F.lit(False))).alias(c) for c in ("TP", "TN", "FP", "FN")],
        F.count_if(case == "origin_known_at_or_below_threshold").alias(
            "origin_known_at_or_below_count"
        ),
        F.count_if(case == "scenario_at_or_below_threshold").alias("scenario_at_or_below_count"),
        F.count_if(above).alias("initially_above_threshold_count"),
        F.count_if(case == "unavailable").alias("unavailable_case_count"),
        gated("forecast_input_status").alias("forecast_unavailable_or_gated_count"),
        gated("retrospective_input_status").alias("retrospective_unavailable_or_gated_count"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    n = tp + tn + fp + fn
    rates = {
        "event_prevalence": ratio(tp + fn, n),
        "missed_crossing_rate": ratio(fn, tp + fn),
        "false_alert_rate": ratio(fp, fp + tn),
        "agreement": ratio(tp + tn, n),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) * 0.5,
    }
    columns = []
    for name in RATES:
        undefined = (
            "unavailable_undefined_class_rate"
            if name == "balanced_accuracy"
            else "unavailable_zero_denominator"
        )
        columns += [
            rates[name].alias(name),
            F.when(rates[name].isNull(), undefined).otherwise("available").alias(f"{name}_status"),
        ]
    return counts.select(
        *fields,
        n.alias("N"),
        "TP",
        "TN",
        "FP",
        "FN",
        "origin_known_at_or_below_count",
        "scenario_at_or_below_count",
        "initially_above_threshold_count",
        n.alias("evaluable_paired_case_count"),
        "unavailable_case_count",
        "forecast_unavailable_or_gated_count",
        "retrospective_unavailable_or_gated_count",
        F.lit(METHOD_STATUS).alias("methodology_status"),
        *columns,
    )


def metric_long(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rates with their own denominators, one row per metric."""
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    both = F.concat(
        F.lit("positive="), (tp + fn).cast("string"), F.lit("; negative="), (tn + fp).cast("string")
    )
    denominators = {
        "event_prevalence": F.col("N"),
        "missed_crossing_rate": tp + fn,
        "false_alert_rate": fp + tn,
        "agreement": F.col("N"),
        "precision": tp + fp,
        "recall": tp + fn,
        "balanced_accuracy": both,
    }
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).alias("value"),
                denominators[name].cast("string").alias("denominator"),
                F.col(f"{name}_status").alias("status"),
            )
            for name in RATES
        ]
    )
    return summary.select(*keys, F.explode(entries).alias("m")).select(*keys, "m.*")


def evaluate(
    records: DataFrame,
    scenario_basis: str | None = None,
    disclosure: Disclosure = Disclosure(),
) -> tuple[DataFrame, DataFrame]:
    """Cases and their per-group summary."""
    cases = exposure_cases(prepare(records, disclosure), scenario_basis, disclosure)
    return cases, confusion_summary(cases)


# --- joining forecasts, snapshots and outcomes ------------------------------


def forecast_inventory_inputs(export: DataFrame, inventory: DataFrame) -> DataFrame:
    """Forecasts with the snapshot of exactly their origin day, if there is one.

    Two snapshots of one series and day fail the job: the join is many-to-one.
    """
    optional = [
        c
        for c in (
            "origin_snapshot_available",
            "origin_snapshot_unavailable_reason",
            "Supplier_Lead_Time_Days",
            "supplier_lead_time_available_at_origin",
            "Order_Quantity",
            "order_quantity_available_at_origin",
        )
        if c in inventory.columns
    ]
    snapshots = inventory.select(
        "SKU_ID",
        "Warehouse_ID",
        F.col("Date").alias("forecast_origin"),
        "Date",
        "Inventory_Level",
        "Reorder_Point",
        *optional,
        F.lit(True).alias("_matched"),
    )
    key = ["SKU_ID", "Warehouse_ID", "forecast_origin"]
    rest = [c for c in snapshots.columns if c not in key]
    repeated = F.raise_error(F.concat_ws(" ", F.lit("duplicate snapshot of"), *key)).cast("boolean")
    single = (
        snapshots.groupBy(*key)
        .agg(F.first(F.struct(*rest)).alias("_s"), F.count(F.lit(1)).alias("_n"))
        .where(F.when(F.col("_n") > 1, repeated).otherwise(F.lit(True)))
        .select(*key, *[F.col(f"_s.{c}").alias(c) for c in rest])
    )
    joined = export.join(single, key, "left")
    unmatched = F.col("_matched").isNull()
    marker = _optional(inventory, "origin_snapshot_available", "boolean")
    given = _optional(inventory, "origin_snapshot_unavailable_reason", "string")
    return joined.withColumns(
        {
            "origin_snapshot_available": F.when(unmatched, F.lit(False)).otherwise(marker),
            "origin_snapshot_unavailable_reason": F.when(
                unmatched, "origin_inventory_record_missing"
            ).otherwise(given),
            "prediction_status": F.col("forecast_status"),
            "eligibility_status": F.when(F.col("prediction") >= 0, "eligible").otherwise(
                "ineligible"
            ),
            "canonical_config_id": F.col("configuration_id"),
        }
    ).drop("_matched")


def duplicate_snapshots(inventory: DataFrame) -> DataFrame:
    """Snapshot identities that would make the origin join many-to-many."""
    return (
        inventory.groupBy("SKU_ID", "Warehouse_ID", "Date")
        .agg(F.count(F.lit(1)).alias("snapshot_rows"))
        .where("snapshot_rows > 1")
    )


def retrospective_targets(forecasts: DataFrame, sales: DataFrame) -> DataFrame:
    """Realised totals of complete, valid daily windows for horizons 1, 7 and 14."""
    wanted = forecasts.where(F.col("horizon").isin(*EVALUABLE_HORIZONS)).select(
        *CASE_KEY, "target_start_date", "target_end_date"
    )
    value = F.col("Units_Sold").cast("double")
    daily = sales.select(
        F.col("SKU_ID").alias("_sku"),
        F.col("Warehouse_ID").alias("_wh"),
        F.col("Date").alias("_day"),
        F.when(finite(value) & (value >= 0) & (value % 1 == 0), value).alias("_units"),
    )
    inside = (
        (F.col("SKU_ID") == F.col("_sku"))
        & (F.col("Warehouse_ID") == F.col("_wh"))
        & F.col("_day").between(F.col("target_start_date"), F.col("target_end_date"))
    )
    sums = (
        wanted.join(daily, inside, "left")
        .groupBy(*CASE_KEY)
        .agg(
            F.count("_day").alias("target_present_days"),
            F.count("_units").alias("_valid"),
            F.sum("_units").alias("_total"),
        )
    )
    missing = F.col("target_present_days") < F.col("horizon")
    complete = ~missing & (F.col("_valid") == F.col("horizon"))
    return sums.select(
        *CASE_KEY,
        F.when(complete, F.col("_total").cast("long")).alias("observed_target"),
        F.when(complete, "complete").otherwise("unavailable").alias("target_status"),
        F.col("horizon").cast("long").alias("target_expected_days"),
        "target_present_days",
        F.when(complete, "")
        .when(missing, "missing_daily_target_records")
        .otherwise("invalid_daily_units_sold")
        .alias("target_unavailable_reason"),
    )


def sales_scope_defects(sales: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Rows that would block the outcome scan: out of window, duplicate, unknown."""
    roster = forecasts.select(
        "SKU_ID", "Warehouse_ID", F.col("forecast_origin").alias("_o")
    ).distinct()
    keyed = sales.groupBy("SKU_ID", "Warehouse_ID", "Date").agg(F.count(F.lit(1)).alias("_n"))
    joined = keyed.join(roster, ["SKU_ID", "Warehouse_ID"], "left")
    age = F.datediff("Date", "_o")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("_o").isNull(), F.col("_n"))), F.lit(0)).alias(
            "unexpected_series_rows"
        ),
        F.coalesce(F.sum(F.when((age < 1) | (age > 14), F.col("_n"))), F.lit(0)).alias(
            "out_of_window_rows"
        ),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(
            "duplicate_key_rows"
        ),
    )


# fixed values: snapshot policies
POLICIES = ("unknown", "source-confirmed", "constructed-origin")
CONSTRUCTED_BASIS = (
    "Recorded same-origin balances are taken as hypothetical starting balances with no "
    "receipts or adjustments; this is not verified source timing."
)


def apply_policy(inventory: DataFrame, policy: str) -> DataFrame:
    """Marker column of the snapshots under a snapshot policy."""
    if policy not in POLICIES:
        raise ValueError(f"unsupported snapshot policy {policy}")
    marker = F.lit(True) if policy == "source-confirmed" else F.lit(None).cast("boolean")
    return inventory.withColumn("origin_snapshot_available", marker)


PROSPECTIVE_FIELDS = [
    *CASE_KEY,
    "target_start_date",
    "target_end_date",
    "prediction",
    "unit",
    "model",
    "configuration_id",
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "Date",
    "Inventory_Level",
    "Reorder_Point",
    "origin_snapshot_available",
    "origin_snapshot_status",
    "origin_snapshot_reason",
    "inventory_state_available",
    "inventory_basis",
    "snapshot_assumption",
    "scenario_inventory_state_available",
    "analysis_inventory_state_available",
    "origin_exposure_state",
    "forecast_exposure_state",
    "inventory_buffer",
    "predicted_margin",
    "forecast_input_status",
    "forecast_input_reason",
    "downstream_use_status",
    "downstream_use_reason",
    "methodology_status",
    "method_assumptions",
    "method_limitations",
]


def prospective_view(
    export: DataFrame,
    inventory: DataFrame,
    policy: str,
    disclosure: Disclosure = Disclosure(),
) -> DataFrame:
    """Origin-known evidence only; no outcome column exists in this relation."""
    basis = CONSTRUCTED_BASIS if policy == "constructed-origin" else None
    inputs = forecast_inventory_inputs(export, apply_policy(inventory, policy))
    cases = exposure_cases(prepare(inputs, disclosure), basis, disclosure)
    gated = F.col("horizon") == 28
    masked = cases.withColumns(
        {
            "scenario_inventory_state_available": F.col("scenario_inventory_state_available")
            & ~gated,
            "analysis_inventory_state_available": F.col("analysis_inventory_state_available")
            & ~gated,
            "origin_exposure_state": F.when(gated, "unavailable").otherwise(
                F.col("origin_exposure_state")
            ),
            "forecast_exposure_state": F.when(gated, "unavailable").otherwise(
                F.col("forecast_exposure_state")
            ),
            "inventory_buffer": F.when(~gated, F.col("inventory_buffer")),
            "predicted_margin": F.when(~gated, F.col("predicted_margin")),
        }
    )
    return masked.select(*[c for c in PROSPECTIVE_FIELDS if c in masked.columns])


def paired_evaluation(
    export: DataFrame,
    inventory: DataFrame,
    sales: DataFrame,
    policy: str,
    disclosure: Disclosure = Disclosure(),
) -> tuple[DataFrame, DataFrame]:
    """Cases and summary after outcomes are joined to the eligible horizons."""
    basis = CONSTRUCTED_BASIS if policy == "constructed-origin" else None
    inputs = forecast_inventory_inputs(export, apply_policy(inventory, policy)).where(
        F.col("horizon").isin(*EVALUABLE_HORIZONS)
    )
    paired = inputs.join(retrospective_targets(export, sales), CASE_KEY, "left")
    return evaluate(paired, basis, disclosure)


# --- contract check of stored prospective rows ------------------------------


def prospective_rules(policy: str, disclosure: Disclosure = Disclosure()) -> dict[str, Column]:
    """Rule name -> condition that must hold on a prospective row.

    Every derived status and margin is recomputed from the row's own inputs;
    nothing is generated or repaired.
    """
    marker = F.col("origin_snapshot_available")
    same_day = F.coalesce(F.col("Date") == F.col("forecast_origin"), F.lit(False))
    expected_status = (
        F.when(marker.isNull(), "unknown")
        .when(marker & same_day, "available")
        .otherwise("unavailable")
    )
    reason = F.col("origin_snapshot_reason")

    def count_ok(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.coalesce(finite(v) & (v >= 0) & (v % 1 == 0), F.lit(False))

    balances = same_day & count_ok("Inventory_Level") & count_ok("Reorder_Point")
    source_ok = F.coalesce(marker, F.lit(False)) & balances
    constructed = policy == "constructed-origin"
    gated = F.col("horizon") == 28
    legacy = F.col("methodology_status") == LEGACY_METHOD_STATUS
    use_status = (
        F.when(gated, "not_approved_for_downstream_use")
        .when(legacy, "proposed_method_not_group_approved")
        .otherwise("approved_method")
    )
    use_reason = (
        F.when(gated, "28_day_downstream_use_requires_separate_approval")
        .when(legacy, "DR-012_remains_proposed_for_group_approval")
        .otherwise("")
    )
    scenario_ok = balances & ~gated if constructed else F.lit(False)
    if constructed:
        analysis_ok = scenario_ok
    else:
        analysis_ok = source_ok & ~gated if policy == "source-confirmed" else F.lit(False)
    buffer = F.col("Inventory_Level").cast("double") - F.col("Reorder_Point").cast("double")
    usable_forecast = F.coalesce(F.col("prediction") >= 0, F.lit(False))
    prefix = "scenario_" if constructed else ""
    origin_state = (
        F.when(~analysis_ok, "unavailable")
        .when(buffer <= 0, f"{prefix}already_at_or_below_threshold")
        .otherwise(f"{prefix}initially_above_threshold")
    )
    known = "not_needed_scenario_origin_state" if constructed else "not_needed_origin_state_known"
    forecast_state = (
        F.when(~analysis_ok, "unavailable")
        .when(buffer <= 0, known)
        .when(~usable_forecast, "unavailable")
        .when(F.col("prediction") >= buffer, "forecast_crossing")
        .otherwise("no_forecast_crossing")
    )
    margin = F.when(analysis_ok & (buffer > 0) & usable_forecast, buffer - F.col("prediction"))
    disclosed = all_of(
        F.forall(c, lambda t: F.trim(t) != "") for c in ("method_assumptions", "method_limitations")
    )
    rules = {
        "methodology_status": F.col("methodology_status").isin(METHOD_STATUS, LEGACY_METHOD_STATUS),
        "evidence_role": F.col("evidence_role") == "primary",
        "snapshot_date": F.col("Date").isNull() | same_day,
        "snapshot_status": F.col("origin_snapshot_status") == expected_status,
        "snapshot_reason": F.when(expected_status == "available", reason == "").otherwise(
            F.trim(reason) != ""
        ),
        "source_inventory": F.col("inventory_state_available") == source_ok,
        "downstream_status": F.col("downstream_use_status") == use_status,
        "downstream_reason": F.col("downstream_use_reason") == use_reason,
        "disclosure": disclosed,
        "scenario_inventory": F.col("scenario_inventory_state_available") == scenario_ok,
        "analysis_inventory": F.col("analysis_inventory_state_available") == analysis_ok,
        "forecast_status": F.col("forecast_input_status")
        == F.when(usable_forecast, "available").otherwise("unavailable"),
        "forecast_reason": F.when(usable_forecast, F.col("forecast_input_reason") == "").otherwise(
            F.trim("forecast_input_reason") != ""
        ),
        "buffer": F.col("inventory_buffer").eqNullSafe(F.when(analysis_ok, buffer)),
        "origin_state": F.col("origin_exposure_state") == origin_state,
        "forecast_state": F.col("forecast_exposure_state") == forecast_state,
        "margin": F.col("predicted_margin").eqNullSafe(margin),
    }
    if constructed:
        rules["basis"] = (F.col("inventory_basis") == "constructed_origin_scenario") & F.coalesce(
            F.col("snapshot_assumption") == CONSTRUCTED_BASIS, F.lit(False)
        )
        rules["marker_policy"] = ~F.coalesce(marker, F.lit(False))
        rules["scenario_disclosure"] = F.array_contains(
            "method_assumptions", CONSTRUCTED_BASIS
        ) & F.array_contains("method_limitations", disclosure.scenario_limitation)
    else:
        rules["basis"] = (F.col("inventory_basis") == "source_availability") & F.col(
            "snapshot_assumption"
        ).isNull()
        rules["marker_policy"] = (
            ~F.coalesce(marker, F.lit(False))
            if policy == "unknown"
            else marker.eqNullSafe(same_day)
        )
    return rules


def rule_violations(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per violated rule; NULL conditions count as violations."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(condition, F.lit(False)), F.lit(name))
                for name, condition in rules.items()
            ]
        )
    )
    return rows.select(*keys, F.explode(broken).alias("rule"))
