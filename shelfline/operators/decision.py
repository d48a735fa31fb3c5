"""Decision-support records, review checklists and view tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.fixed import CRITERIA, SERIES
from shelfline.functions.expr import explode_values, ratio, strict_date
from shelfline.operators.inventory import CASE_KEY

# fixed values: reasons of unavailable record fields
NO_REPLENISHMENT = (
    "not produced; no approved numerical replenishment output supplied for this case."
)
NO_UNCERTAINTY = (
    "no_agreed_method; source forecast uncertainty is unavailable. "
    "Retrospective errors are excluded."
)
NO_INVENTORY = (
    "pending upstream output; no reviewed inventory evidence linked for this forecast key."
)
NO_INVENTORY_28 = (
    "28_day_downstream_use_requires_separate_approval; no reviewed inventory evidence linked."
)
NO_SNAPSHOT = "inventory_snapshot_missing_or_invalid"
REVIEW_STATUSES = ("not_assessed", "review_required")
OUTCOMES = ("met", "not met", "not assessable")

EVIDENCE_FIELDS = [
    "inventory_basis",
    "snapshot_assumption",
    "origin_snapshot_status",
    "origin_exposure_state",
    "forecast_exposure_state",
    "inventory_buffer",
    "predicted_margin",
    "forecast_input_status",
    "forecast_input_reason",
    "methodology_status",
]
# own wording: disclosures every record carries
LIMITATIONS = (
    "The source data is simulated; no effect at a real retailer is shown.",
    "The stockout flag never varies and cannot validate stockout predictions.",
    "Selected forecasts are purposive and not statistically representative.",
    "No replenishment evidence is supplied.",
    "A record's content does not establish that a user interface shows it.",
)
NEGATIVE_LIMITATION = "The raw forecast is negative and kept as is; inventory use is unavailable."
LONG_LIMITATION = "The 28-day case is in scope for forecast transparency only."


def numbered(rows: DataFrame, prefix: str = "F", width: int = 2) -> DataFrame:
    """Running ids over (SKU, warehouse, horizon) order without a global sort.

    Group sizes per SKU give each SKU its offset (one row per SKU), positions
    inside a SKU come from a window bounded by its warehouses and horizons.
    """
    sizes = rows.groupBy("SKU_ID").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("SKU_ID").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("SKU_ID", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("SKU_ID").orderBy("Warehouse_ID", "horizon")
    number = F.col("_o") + F.row_number().over(inside)
    text = number.cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return rows.join(offsets, "SKU_ID").withColumn(
        "assessment_id", F.concat(F.lit(prefix), padded)
    ).drop("_o")


def build_records(
    export: DataFrame,
    prospective: DataFrame | None = None,
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One nested record per selected (series, horizon).

    ``pairs`` is the purposive selection; without it every series is taken.
    Missing evidence is null with a reason in ``unavailable_fields``.
    """
    rows = export
    if pairs is not None:
        wanted = F.lit(False)
        for sku, warehouse in pairs:
            wanted = wanted | ((F.col("SKU_ID") == sku) & (F.col("Warehouse_ID") == warehouse))
        rows = rows.where(wanted)
    long_horizon = F.col("horizon") == 28
    if prospective is None:
        joined = rows.withColumns(
            {
                "_evidence": F.lit(None).cast("string"),
                "_reason": F.when(long_horizon, NO_INVENTORY_28).otherwise(NO_INVENTORY),
                "_assumptions": F.array().cast("array<string>"),
                "_limitations": F.array().cast("array<string>"),
            }
        )
        linked = False
    else:
        usable = ~long_horizon & F.col("analysis_inventory_state_available")
        reason = F.when(long_horizon, F.col("downstream_use_reason")).when(
            F.col("origin_snapshot_reason") != "", F.col("origin_snapshot_reason")
        )
        evidence = prospective.select(
            *CASE_KEY,
            F.when(usable, F.struct(*EVIDENCE_FIELDS)).alias("_evidence"),
            F.coalesce(reason, F.lit(NO_SNAPSHOT)).alias("_reason"),
            F.col("method_assumptions").alias("_assumptions"),
            F.col("method_limitations").alias("_limitations"),
        )
        joined = rows.join(evidence, CASE_KEY, "left")
        linked = True
    missing = F.col("_evidence").isNull()
    no_text = F.array().cast("array<string>")
    provenance = F.to_json(
        F.struct(
            "SKU_ID",
            "Warehouse_ID",
            "configuration_id",
            "forecast_origin",
            "forecast_status",
            "horizon",
            "model",
            "producer_status",
            "run_id",
        )
    )
    reason = F.coalesce("_reason", F.lit(NO_SNAPSHOT))
    unavailable = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(missing, F.struct(F.lit("inventory_risk_evidence"), reason)),
                F.when(missing, F.struct(F.lit("inventory_risk_provenance"), reason)),
                F.struct(F.lit("replenishment_recommendation"), F.lit(NO_REPLENISHMENT)),
                F.struct(F.lit("uncertainty_or_error"), F.lit(NO_UNCERTAINTY)),
            )
        )
    )
    components = ["forecast", "decision_support"] + (["inventory_risk"] if linked else [])
    target = F.concat(
        F.lit("The target runs from "),
        F.col("target_start_date").cast("string"),
        F.lit(" to "),
        F.col("target_end_date").cast("string"),
        F.lit(", both days included."),
    )
    shaped = joined.select(
        *SERIES,
        "horizon",
        "forecast_origin",
        F.concat(F.col("horizon").cast("string"), F.lit("-day")).alias("forecast_horizon"),
        F.col("prediction").alias("forecast_demand"),
        provenance.alias("forecast_provenance"),
        F.col("_evidence").alias("inventory_risk_evidence"),
        F.when(~missing, F.lit("prospective")).alias("inventory_risk_provenance"),
        F.lit(None).cast("double").alias("replenishment_recommendation"),
        F.lit(None).cast("double").alias("uncertainty_or_error"),
        F.concat(
            F.array(
                target,
                F.lit("Multi-day quantities are cumulative totals, not daily paths."),
            ),
            F.coalesce("_assumptions", no_text),
        ).alias("assumptions"),
        F.concat(
            F.array(*[F.lit(t) for t in LIMITATIONS]),
            F.when(F.col("prediction") < 0, F.array(F.lit(NEGATIVE_LIMITATION))).otherwise(no_text),
            F.when(long_horizon, F.array(F.lit(LONG_LIMITATION))).otherwise(no_text),
            F.coalesce("_limitations", no_text),
        ).alias("limitations"),
        F.lit("not_assessed").alias("human_review_status"),
        F.array(F.lit("No person has reviewed this record yet.")).alias("human_review_reasons"),
        unavailable.alias("unavailable_fields"),
        F.create_map(*[F.lit(x) for c in components for x in (c, c)]).alias("component_provenance"),
    )
    return numbered(shaped)


UPSTREAM_FIELDS = [
    "forecast_demand",
    "forecast_provenance",
    "inventory_risk_evidence",
    "inventory_risk_provenance",
    "replenishment_recommendation",
    "uncertainty_or_error",
]


def record_rules() -> dict[str, Column]:
    """Contract of a record: every null upstream field needs its own reason."""
    rules = {
        f"{c}_explained": F.col(c).isNotNull()
        | (F.coalesce(F.element_at("unavailable_fields", F.lit(c)), F.lit("")) != "")
        for c in UPSTREAM_FIELDS
    }
    rules["review_status"] = F.col("human_review_status").isin(*REVIEW_STATUSES)
    rules["review_reasons"] = F.size("human_review_reasons") > 0
    rules["component_provenance"] = F.size("component_provenance") > 0
    return rules


def checklist(records: DataFrame) -> DataFrame:
    """Unassessed checks: every record times every criterion."""
    criteria = explode_values([(c,) for c in CRITERIA], ["criterion"])
    blanks = ["applicable", "outcome", "reason", "evidence", "assessor", "assessed_on"]
    identity = ["assessment_id", *SERIES, "forecast_origin", "horizon"]
    return records.select(*identity, criteria.alias("_c")).select(
        *identity, "_c.criterion", *[F.lit("").alias(b) for b in blanks]
    )


def review_rules() -> dict[str, Column]:
    """Contract of a human-entered check."""
    applicable, outcome = F.col("applicable"), F.col("outcome")
    reason, evidence = F.trim("reason") != "", F.trim("evidence") != ""
    entered = outcome.isin(*OUTCOMES)
    return {
        "assessor": F.trim("assessor") != "",
        "assessed_on": strict_date("assessed_on").isNotNull(),
        "applicability": applicable.isin("yes", "no"),
        "not_applicable_form": (applicable != "no") | ((outcome == "") & reason),
        "outcome_entered": (applicable != "yes") | entered,
        "outcome_supported": (applicable != "yes")
        | ~entered
        | F.when(outcome == "met", evidence).otherwise(reason),
    }


def review_coverage(reviews: DataFrame, template: DataFrame) -> DataFrame:
    """Checks that are missing, unknown, duplicate or changed their identity."""
    from shelfline.functions.grids import grid_difference

    return grid_difference(
        template, reviews, ["assessment_id", "criterion", *SERIES, "forecast_origin", "horizon"]
    )


def tally(reviews: DataFrame) -> DataFrame:
    """Counts per criterion; proportions over all applicable checks."""
    yes = F.col("applicable") == "yes"
    counts = reviews.groupBy("criterion").agg(
        F.count_if(yes).alias("applicable"),
        F.count_if(F.col("applicable") == "no").alias("not_applicable"),
        F.count_if(yes & (F.col("outcome") == "met")).alias("met"),
        F.count_if(yes & (F.col("outcome") == "not met")).alias("not_met"),
        F.count_if(yes & (F.col("outcome") == "not assessable")).alias("not_assessable"),
    )
    return counts.withColumn("met_proportion", ratio(F.col("met"), F.col("applicable")))


def tally_reconciliation(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Do the outcome and applicability counts add up?"""
    total = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select(
        "criterion",
        (F.col("met") + F.col("not_met") + F.col("not_assessable") == F.col("applicable")).alias(
            "outcomes_reconcile"
        ),
        (F.col("applicable") + F.col("not_applicable") == total).alias("records_reconcile"),
    )


def eligible_pool(records: DataFrame) -> DataFrame:
    """Seven-day records with available inventory and forecast evidence."""
    return records.where(
        (F.col("horizon") == 7)
        & F.col("inventory_risk_evidence").isNotNull()
        & (F.col("inventory_risk_evidence.forecast_input_status") == "available")
    )


def seeded_pick(pool: DataFrame, seed: str) -> DataFrame:
    """One reproducible member of the pool: smallest hash of seed and id."""
    if not seed.strip():
        raise ValueError("a nonblank seed is required")
    rank = F.md5(F.concat(F.lit(seed), F.col("assessment_id")))
    return pool.agg(
        F.min_by("assessment_id", rank).alias("assessment_id"),
        F.count(F.lit(1)).alias("pool_size"),
    )


def lookup(records: DataFrame, assessment_id: str | None = None) -> DataFrame:
    """Roster of records, or one by id (empty when absent)."""
    roster = records.select("assessment_id", *SERIES, "horizon", "forecast_horizon")
    return roster if assessment_id is None else roster.where(F.col("assessment_id") == assessment_id)


def request_history(panel: DataFrame, origin) -> DataFrame:
    """Full daily history before and at the origin as one array per series.

    The array is bounded by the calendar; ``complete`` is false when a day of
    the series' own span is absent.
    """
    rows = panel.where(F.col("Date") <= F.lit(origin))
    return rows.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("Date", "Units_Sold"))).alias("history"),
        F.count(F.lit(1)).alias("days"),
        (F.datediff(F.max("Date"), F.min("Date")) + 1 == F.count(F.lit(1))).alias("_dense"),
        (F.max("Date") == F.lit(origin)).alias("_ends"),
    ).select(*SERIES, "history", "days", (F.col("_dense") & F.col("_ends")).alias("complete"))


def retrospective_error(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """Signed, absolute and percentage error; zero actuals have no percentage."""
    joined = forecasts.select(*CASE_KEY, "target_start_date", "target_end_date", "prediction").join(
        observations.select(*CASE_KEY, "observed_target"), CASE_KEY
    )
    actual = F.col("observed_target").cast("double")
    error = F.col("prediction") - actual
    return joined.select(
        *CASE_KEY,
        "target_start_date",
        "target_end_date",
        F.col("prediction").alias("forecast_quantity"),
        F.col("observed_target").alias("actual_units_sold"),
        error.alias("signed_error_prediction_minus_actual"),
        F.abs(error).alias("absolute_error"),
        (ratio(F.abs(error), actual) * 100).alias("absolute_percentage_error"),
        F.when(actual == 0, "actual_sales_zero").alias("percentage_error_unavailable_reason"),
    )


# --- views ------------------------------------------------------------------


def horizon_population(prospective: DataFrame) -> DataFrame:
    return prospective.groupBy("forecast_origin", "horizon").agg(
        F.count(F.lit(1)).alias("horizon_forecast_population_count")
    )


def coverage_view(prospective: DataFrame, summary: DataFrame) -> DataFrame:
    """Forecast population beside the evaluation counts (absent at 28 days)."""
    counts = summary.select(
        "forecast_origin",
        "horizon",
        "N",
        "TP",
        "TN",
        "FP",
        "FN",
        "scenario_at_or_below_count",
        "origin_known_at_or_below_count",
        "unavailable_case_count",
        "forecast_unavailable_or_gated_count",
        "retrospective_unavailable_or_gated_count",
    )
    return horizon_population(prospective).join(counts, ["forecast_origin", "horizon"], "left")


def crossings_view(summary: DataFrame) -> DataFrame:
    """Nested group, counts and metrics with denominators, one row per group."""
    from shelfline.fixed import GROUP_FIELDS, RATES

    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    denominators = {
        "event_prevalence": F.col("N"),
        "missed_crossing_rate": tp + fn,
        "false_alert_rate": fp + tn,
        "agreement": F.col("N"),
        "precision": tp + fp,
        "recall": tp + fn,
        "balanced_accuracy": tp + tn + fp + fn,
    }
    metrics = F.struct(
        *[
            F.struct(
                F.col(n).alias("value"),
                denominators[n].alias("denominator"),
                F.col(f"{n}_status").alias("status"),
            ).alias(n)
            for n in RATES
        ]
    )
    group = [c for c in GROUP_FIELDS if c in summary.columns]
    return summary.select(
        F.struct(*group).alias("group"),
        F.struct("N", "TP", "TN", "FP", "FN", "unavailable_case_count").alias("counts"),
        metrics.alias("metrics"),
    )


MARGIN_FIELDS = [
    *CASE_KEY,
    "target_start_date",
    "target_end_date",
    "inventory_basis",
    "inventory_buffer",
    "origin_exposure_state",
]


def margin_views(prospective: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predicted and retrospective margins, kept in separate relations."""
    short = F.col("horizon").isin(1, 7, 14)
    predicted = prospective.where(short).select(
        *MARGIN_FIELDS, "predicted_margin", "forecast_exposure_state", "forecast_input_reason"
    )
    realised = cases.where(short).select(
        *MARGIN_FIELDS,
        "retrospective_margin",
        "retrospective_exposure_state",
        "retrospective_input_reason",
    )
    return predicted, realised


def availability_view(prospective: DataFrame, export: DataFrame) -> DataFrame:
    """Status matrix of prospective rows and their export rows, gated at 28."""
    from shelfline.operators.export import gate_by_horizon

    joined = prospective.select(
        *CASE_KEY,
        "downstream_use_status",
        "downstream_use_reason",
        "prediction",
        "origin_snapshot_status",
        "origin_snapshot_reason",
        "inventory_state_available",
        "forecast_input_status",
        "forecast_input_reason",
    ).join(
        export.select(*CASE_KEY, "forecast_status", "producer_status", "forecast_type"), CASE_KEY
    )
    return gate_by_horizon(joined, [*CASE_KEY, "downstream_use_status", "downstream_use_reason"])


def mark_designated(comparison: DataFrame, export: DataFrame) -> DataFrame:
    """Flag comparison rows whose (model, configuration, horizon) was exported."""
    producers = export.select("model", "configuration_id", "horizon").distinct()
    return comparison.join(
        producers.withColumn("_d", F.lit(True)), ["model", "configuration_id", "horizon"], "left"
    ).withColumn("designated_producer", F.col("_d").isNotNull()).drop("_d")


def case_index(cases: DataFrame) -> DataFrame:
    """Identity and comparison outcome of every evaluated case."""
    return cases.select(
        *CASE_KEY,
        "target_start_date",
        "target_end_date",
        "model",
        "configuration_id",
        "comparison_case",
        "confusion_cell",
        "predicted_margin",
        "retrospective_margin",
        F.array_join("evaluation_unavailable_reasons", ";").alias("evaluation_unavailable_reasons"),
    )


