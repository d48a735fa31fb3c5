"""Status matrix of the exposure operators."""

from datetime import date

import pytest

from shelfline.operators import inventory as iv

BASE = dict(
    SKU_ID="SKU001", Warehouse_ID="WH001", forecast_origin="2024-01-01", Date="2024-01-01",
    target_start_date="2024-01-02", target_end_date="2024-01-08", horizon=7, prediction=8.5,
    observed_target=9.0, prediction_status="available", target_status="complete",
    eligibility_status="eligible", run_id="run-a", evaluation_stage="validation",
    evidence_role="primary", model="xgboost", configuration_id="GBM001", fold_id=1,
    Inventory_Level=20.0, Reorder_Point=10.0, origin_snapshot_available=True,
    origin_snapshot_unavailable_reason="", Supplier_Lead_Time_Days=7, Order_Quantity=0,
)
KINDS = {str: "string", int: "int", float: "double", bool: "boolean"}
SCHEMA = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in BASE.items())


def records(spark, *changes):
    rows = [tuple({**BASE, **c}.values()) for c in changes]
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, scenario=None, **change):
    cases = iv.exposure_cases(iv.prepare(records(spark, change)), scenario)
    return cases.collect()[0]


@pytest.mark.parametrize(
    "pred, obs, cell",
    [(10.0, 10.0, "TP"), (9.0, 9.0, "TN"), (10.0, 9.0, "FP"), (9.0, 10.0, "FN")],
)
def test_confusion_cells(spark, pred, obs, cell):
    row = one(spark, prediction=pred, observed_target=obs)
    assert row.confusion_cell == cell and row.predicted_margin == 10 - pred


@pytest.mark.parametrize(
    "change, reason",
    [
        (dict(prediction=None), "forecast_missing_or_nonfinite"),
        (dict(prediction=float("nan")), "forecast_missing_or_nonfinite"),
        (dict(prediction=-1.0), "negative_forecast_handling_not_approved"),
        (dict(prediction_status=None), "forecast_prediction_status_not_available"),
        (dict(eligibility_status="x"), "forecast_eligibility_status_not_eligible"),
        (dict(observed_target=2.5), "realised_horizon_demand_unavailable"),
        (dict(target_status="x"), "retrospective_target_status_not_complete"),
        (
            dict(target_end_date="2024-01-09"),
            "forecast_target_interval_does_not_match_origin_and_horizon",
        ),
        (dict(horizon=3), "unsupported_or_invalid_forecast_horizon"),
        (dict(Inventory_Level=-1.0), "inventory_level_missing_or_invalid"),
        (dict(origin_snapshot_available=None), "origin_snapshot_availability_not_established"),
        (
            dict(origin_snapshot_available=False),
            "origin_snapshot_not_available_at_forecast_origin",
        ),
        (
            dict(Date="2024-01-02"),
            "inventory_record_date_does_not_match_forecast_origin",
        ),
    ],
)
def test_one_bad_cell_is_named_and_never_counted(spark, change, reason):
    row = one(spark, **change)
    assert reason in row.evaluation_unavailable_reasons
    assert row.confusion_cell is None and row.comparison_case == "unavailable"


def test_known_state_needs_no_forecast(spark):
    row = one(spark, Inventory_Level=10.0, prediction=None, observed_target=None)
    assert row.comparison_case == "origin_known_at_or_below_threshold"
    assert row.forecast_exposure_state == "not_needed_origin_state_known"
    assert row.evaluation_unavailable_reasons == []


def test_gated_horizon_has_no_comparison(spark):
    row = one(spark, horizon=28, target_end_date="2024-01-29")
    assert row.confusion_cell is None
    assert row.evaluation_unavailable_reasons == [
        "28_day_downstream_use_requires_separate_approval"
    ]


def test_scenario_keeps_source_status(spark):
    row = one(spark, "basis text", origin_snapshot_available=False)
    assert row.origin_snapshot_status == "unavailable"
    assert row.origin_exposure_state == "scenario_initially_above_threshold"
    assert row.method_assumptions[-1] == "basis text"


def test_absent_columns_change_the_reason(spark):
    frame = records(spark, {}).drop("prediction_status", "Order_Quantity", "target_status")
    row = iv.prepare(frame).collect()[0]
    assert row.forecast_input_reason == "forecast_prediction_status_not_provided"
    assert row.retrospective_input_reason == "retrospective_target_status_not_provided"
    assert "Order_Quantity_not_provided" in row.preparation_unavailable_reasons


def test_missing_required_column_raises(spark):
    with pytest.raises(ValueError, match="Reorder_Point"):
        iv.prepare(records(spark, {}).drop("Reorder_Point"))


def test_summary_of_canonical_rows(spark):
    pairs = [(10.0, 10.0), (9.0, 9.0), (10.0, 9.0), (9.0, 10.0)]
    rows = [
        dict(SKU_ID=f"S{i}", prediction=p, observed_target=o) for i, (p, o) in enumerate(pairs)
    ]
    rows.append(dict(SKU_ID="S9", Inventory_Level=10.0))
    _, summary = iv.evaluate(records(spark, *rows))
    s = summary.collect()[0]
    assert (s.N, s.TP, s.TN, s.FP, s.FN, s.origin_known_at_or_below_count) == (4, 1, 1, 1, 1, 1)
    assert s.balanced_accuracy == 0.5


def test_prospective_rows_ignore_outcomes(spark):
    a = one(spark, observed_target=1.0)
    b = one(spark, observed_target=500.0)
    for name in ("predicted_margin", "forecast_exposure_state", "origin_exposure_state"):
        assert a[name] == b[name]


def test_retrospective_targets_need_every_day(spark):
    export = spark.createDataFrame(
        [("A", "W", date(2024, 1, 1), 7, date(2024, 1, 2), date(2024, 1, 8))],
        "SKU_ID string, Warehouse_ID string, forecast_origin date, horizon int, "
        "target_start_date date, target_end_date date",
    )
    days = [("A", "W", date(2024, 1, 1 + i), 2.0) for i in range(1, 8)]
    schema = "SKU_ID string, Warehouse_ID string, Date date, Units_Sold double"

    def result(rows):
        return iv.retrospective_targets(export, spark.createDataFrame(rows, schema)).collect()[0]

    assert result(days).observed_target == 14
    assert result(days[1:]).target_unavailable_reason == "missing_daily_target_records"
    broken = [*days[:-1], (*days[-1][:3], 0.5)]
    assert result(broken).target_unavailable_reason == "invalid_daily_units_sold"
