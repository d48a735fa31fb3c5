"""Fixed values of the data model: names, statuses and reasons.

These are contract values.  Downstream consumers compare them literally, so they
are stated once, in plain text and in their natural order.
"""

from __future__ import annotations

from datetime import date

# --- fixed values: source columns -------------------------------------------
SERIES = ["SKU_ID", "Warehouse_ID"]
KEY = ["Date", "SKU_ID", "Warehouse_ID"]
IDENTIFIERS = ["SKU_ID", "Warehouse_ID", "Supplier_ID", "Region"]
COUNTS = [
    "Units_Sold",
    "Inventory_Level",
    "Supplier_Lead_Time_Days",
    "Reorder_Point",
    "Order_Quantity",
]
MONEY = ["Unit_Cost", "Unit_Price"]
FLAGS = ["Promotion_Flag", "Stockout_Flag"]
NUMERIC = COUNTS + MONEY + FLAGS + ["Demand_Forecast"]
PANEL_COLUMNS = ["Date"] + IDENTIFIERS + NUMERIC
INVENTORY_COLUMNS = [
    "Inventory_Level",
    "Reorder_Point",
    "Supplier_Lead_Time_Days",
    "Order_Quantity",
]

# --- fixed values: features and targets -------------------------------------
LAGS = (1, 7, 14)
ROLLING_WINDOWS = (7, 14, 28)
SLOPE_WINDOW = 14
PROFILE_LAGS = (1, 7, 14, 28)
HORIZONS = (1, 7, 14, 28)
EVALUABLE_HORIZONS = (1, 7, 14)
FEATURES = [
    "dow_sin",
    "dow_cos",
    "lag_1",
    "lag_7",
    "lag_14",
    "rolling_mean_7",
    "rolling_std_7",
    "rolling_mean_14",
    "rolling_std_14",
    "rolling_mean_28",
    "rolling_std_28",
    "rolling_slope_14",
]

# --- fixed values: models, roles and grid -----------------------------------
PRIMARY_MODELS = ("xgboost", "lightgbm", "catboost")
SUPPORTIVE_MODELS = ("ridge", "random_forest")
BASELINE_MODELS = ("naive", "seasonal_naive")
MODEL_ORDER = PRIMARY_MODELS + SUPPORTIVE_MODELS + BASELINE_MODELS
GRID_LEARNING_RATE = (0.03, 0.05, 0.10)
GRID_ITERATIONS = (100, 300)
GRID_DEPTH = (4, 8)
GRID_SUBSAMPLE = (0.8, 1.0)
SEED = 42
RIDGE_ALPHA = 1.0
FOREST_TREES = 300
PRODUCERS = (
    (1, "lightgbm", "GBM018"),
    (7, "lightgbm", "GBM011"),
    (14, "xgboost", "GBM022"),
    (28, "xgboost", "GBM003"),
)
METRICS = ("wape", "mae", "rmse", "bias")

# --- fixed values: exclusion reasons ----------------------------------------
EXCLUSIONS = (
    "incomplete_predictor_history",
    "target_after_training_cutoff",
    "missing_observed_training_target",
)

# --- fixed values: exposure summary group fields ----------------------------
GROUP_FIELDS = (
    "inventory_basis",
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "model",
    "configuration_id",
    "horizon",
    "forecast_origin",
    "canonical_config_id",
    "fold_id",
    "target_start_date",
    "target_end_date",
    "selection_status",
    "representation_id",
)
RATES = (
    "event_prevalence",
    "missed_crossing_rate",
    "false_alert_rate",
    "agreement",
    "precision",
    "recall",
    "balanced_accuracy",
)

# --- fixed values: review criteria ------------------------------------------
CRITERIA = (
    "Forecast visibility",
    "Risk visibility",
    "Recommendation traceability",
    "Uncertainty visibility",
    "Assumption visibility",
    "Limitation visibility",
    "Human-review transparency",
    "Source distinction",
)

# --- fixed values: evidence table layouts -----------------------------------
CANDIDATE_COLUMNS = [
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "model",
    "horizon",
    "configuration_id",
    "canonical_config_id",
]
FOLD_METRIC_COLUMNS = CANDIDATE_COLUMNS + [
    "fold_id",
    "training_start",
    "training_end",
    "forecast_origin",
    "target_start_date",
    "target_end_date",
    "n_predictions",
    "wape",
    "mae",
    "rmse",
    "bias",
    "wape_denominator",
    "metric_status",
    "failure_reason",
]
SUMMARY_COLUMNS = CANDIDATE_COLUMNS + [
    "expected_fold_count",
    "valid_fold_count",
    "n_predictions",
    "mean_wape",
    "mean_mae",
    "mean_rmse",
    "mean_bias",
    "metric_status",
    "failure_reason",
    "selected_configuration",
    "selection_status",
    "review_status",
]
PREDICTION_COLUMNS = [
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "fold_id",
    "model",
    "horizon",
    "configuration_id",
    "canonical_config_id",
    "SKU_ID",
    "Warehouse_ID",
    "training_start",
    "training_end",
    "forecast_origin",
    "target_start_date",
    "target_end_date",
    "prediction",
    "observed_target",
    "prediction_status",
    "target_status",
    "eligibility_status",
    "selected_configuration",
    "selection_status",
    "representation_id",
]
ELIGIBILITY_COLUMNS = [
    "run_id",
    "evaluation_stage",
    "evidence_role",
    "model",
    "horizon",
    "fold_id",
    "SKU_ID",
    "Warehouse_ID",
    "raw_row_count",
    "feature_eligible_count",
    "label_eligible_count",
    "training_row_count",
    "expected_origin_count",
    "scored_origin_count",
    "exclusion_reason",
    "reason_count",
    "overlapping_reasons",
]


def role_of(model: str) -> str:
    """Evidence role of a model family."""
    if model in PRIMARY_MODELS:
        return "primary"
    return "supportive" if model in SUPPORTIVE_MODELS else "simple_baseline"


class Fold:
    """One expanding training window and its 28-day outcome window."""

    def __init__(self, fold_id: int, start: date, end: date, outcome_end: date):
        self.fold_id = fold_id
        self.start = start
        self.end = end
        self.outcome_end = outcome_end


def fold_calendar(year: int) -> list[Fold]:
    """Four validation folds plus the final fold (id 5) on a calendar year."""
    first = date(year, 1, 1)
    return [
        Fold(1, first, date(year, 3, 31), date(year, 4, 28)),
        Fold(2, first, date(year, 6, 30), date(year, 7, 28)),
        Fold(3, first, date(year, 9, 30), date(year, 10, 28)),
        Fold(4, first, date(year, 11, 4), date(year, 12, 2)),
        Fold(5, first, date(year, 12, 2), date(year, 12, 30)),
    ]


FINAL_FOLD = 5
