"""Request-time scoring from a request's own nested history.

The history array is bounded (28 to 366 days), so features come from
higher-order functions inside the row: no shuffle, no state.  The same function
serves batch tables and streams.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import HORIZONS, LAGS, ROLLING_WINDOWS, SLOPE_WINDOW
from shelfline.functions.expr import finite, strict_date
from shelfline.operators.export import forecast_type
from shelfline.operators.features import SLOPE_CENTRE, SLOPE_DENOMINATOR

REQUEST_SCHEMA = (
    "SKU_ID STRING, Warehouse_ID STRING, forecast_origin STRING, horizon INT, "
    "input_kind STRING, history ARRAY<STRUCT<Date: STRING, Units_Sold: DOUBLE>>"
)
SHORTEST, LONGEST = 28, 366

# fixed values: rejection codes in order of precedence
REJECTIONS = (
    "unsupported_horizon",
    "unknown_sku",
    "unknown_warehouse",
    "invalid_origin",
    "insufficient_history",
    "invalid_history",
    "future_history",
    "incomplete_history",
)


def sorted_history(c: Column | str = "history") -> Column:
    """(day, units) pairs in date order; unparsable dates become NULL days."""
    h = F.col(c) if isinstance(c, str) else c
    return F.array_sort(
        F.transform(
            h,
            lambda e: F.struct(
                strict_date(e["Date"]).alias("day"), e["Units_Sold"].cast("double").alias("units")
            ),
        )
    )


def _valid_rows(h: Column) -> Column:
    def good(e: Column) -> Column:
        u = e["units"]
        whole = u.isNull() | (finite(u) & (u >= 0) & (u % 1 == 0))
        return F.coalesce(e["day"].isNotNull() & whole, F.lit(False))

    return F.forall(h, good)


def _consecutive(h: Column) -> Column:
    """Sorted days without gap or repetition."""
    later = F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))
    steps = F.zip_with(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))),
        later,
        lambda a, b: F.datediff(b["day"], a["day"]) == 1,
    )
    return F.forall(steps, lambda ok: F.coalesce(ok, F.lit(False)))


def classify(requests: DataFrame, skus: list[str], warehouses: list[str], training_end) -> DataFrame:
    """Add ``rejection``: NULL for valid requests, else the first matching code.

    ``skus`` and ``warehouses`` are the vocabularies of the loaded model.
    """
    prepared = requests.withColumns(
        {"_origin": strict_date("forecast_origin"), "_history": sorted_history()}
    )
    h, origin = F.col("_history"), F.col("_origin")
    size = F.coalesce(F.size("_history"), F.lit(0))
    newest = F.when(size > 0, F.element_at(h, -1)["day"])
    recent = F.slice(h, F.greatest(size - (SHORTEST - 1), F.lit(1)), F.lit(SHORTEST))
    complete = F.coalesce(newest == origin, F.lit(False)) & F.forall(
        recent, lambda e: e["units"].isNotNull()
    )
    bad = ~(F.coalesce(_valid_rows(h), F.lit(False)) & F.coalesce(_consecutive(h), F.lit(False)))
    rejection = (
        F.when(~F.coalesce(F.col("horizon").isin(*HORIZONS), F.lit(False)), REJECTIONS[0])
        .when(~F.coalesce(F.col("SKU_ID").isin(*skus), F.lit(False)), REJECTIONS[1])
        .when(~F.coalesce(F.col("Warehouse_ID").isin(*warehouses), F.lit(False)), REJECTIONS[2])
        .when(origin.isNull() | (origin < F.lit(training_end)), REJECTIONS[3])
        .when((size < SHORTEST) | (size > LONGEST), REJECTIONS[4])
        .when(bad, REJECTIONS[5])
        .when(F.coalesce(newest > origin, F.lit(True)), REJECTIONS[6])
        .when(~complete, REJECTIONS[7])
    )
    return prepared.withColumn("rejection", rejection)


def classify_with_tables(
    requests: DataFrame, skus: DataFrame, warehouses: DataFrame, training_end
) -> DataFrame:
    """`classify` against vocabulary relations of any size (two left joins)."""
    known = requests.join(
        skus.select("SKU_ID", F.lit(True).alias("_sku_known")), "SKU_ID", "left"
    ).join(
        warehouses.select("Warehouse_ID", F.lit(True).alias("_wh_known")), "Warehouse_ID", "left"
    )
    base = classify(
        known.withColumns({"_sku": F.col("SKU_ID"), "_wh": F.col("Warehouse_ID")}).withColumns(
            {
                "SKU_ID": F.when(F.col("_sku_known"), "known").otherwise("unknown"),
                "Warehouse_ID": F.when(F.col("_wh_known"), "known").otherwise("unknown"),
            }
        ),
        ["known"],
        ["known"],
        training_end,
    )
    return base.withColumns({"SKU_ID": F.col("_sku"), "Warehouse_ID": F.col("_wh")}).drop(
        "_sku", "_wh", "_sku_known", "_wh_known"
    )


def request_features(requests: DataFrame) -> DataFrame:
    """The twelve features at the day after the origin, from the array alone."""
    units = F.transform("_history", lambda e: e["units"])
    base = requests.withColumns(
        {"_units": units, "Date": F.date_add("_origin", 1)}
    )
    u = F.col("_units")

    def last(n: int) -> Column:
        return F.slice(u, F.size(u) - (n - 1), n)

    def total(a: Column, f=lambda x: x) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))

    phase = F.weekday("Date") * (2 * math.pi / 7)
    columns = {"dow_sin": F.sin(phase), "dow_cos": F.cos(phase)}
    for lag in LAGS:
        columns[f"lag_{lag}"] = F.element_at(u, -lag)
    for n in ROLLING_WINDOWS:
        columns[f"rolling_mean_{n}"] = total(last(n)) / n
    weighted = F.aggregate(
        F.zip_with(
            last(SLOPE_WINDOW),
            F.sequence(F.lit(1), F.lit(SLOPE_WINDOW)),
            lambda x, i: x * (i - SLOPE_CENTRE),
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    columns["rolling_slope_14"] = weighted / SLOPE_DENOMINATOR
    with_means = base.withColumns(columns)
    spreads = {
        f"rolling_std_{n}": F.sqrt(
            total(
                last(n),
                lambda x, n=n: (x - F.col(f"rolling_mean_{n}")) * (x - F.col(f"rolling_mean_{n}")),
            )
            / (n - 1)
        )
        for n in ROLLING_WINDOWS
    }
    return with_means.withColumns(spreads).drop("_units")


def input_hash(requests: DataFrame) -> Column:
    """sha256 of the request as canonical JSON (sorted keys, no spaces)."""
    history = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                "_history",
                lambda e: F.concat(
                    F.lit('{"Date":"'),
                    e["day"].cast("string"),
                    F.lit('","Units_Sold":'),
                    F.coalesce(e["units"].cast("long").cast("string"), F.lit("null")),
                    F.lit("}"),
                ),
            ),
            ",",
        ),
        F.lit("]"),
    )

    def quoted(c: str) -> Column:
        # to_json of a one-field struct gives the escaped JSON text of a value
        one = F.to_json(F.struct(F.col(c).alias("v")))
        return F.coalesce(F.regexp_extract(one, r'^\{"v":(.*)\}$', 1), F.lit("null"))

    text = F.concat(
        F.lit('{"SKU_ID":'), quoted("SKU_ID"),
        F.lit(',"Warehouse_ID":'), quoted("Warehouse_ID"),
        F.lit(',"forecast_origin":'), quoted("forecast_origin"),
        F.lit(',"history":'), history,
        F.lit(',"horizon":'), F.col("horizon").cast("string"),
        F.lit(',"input_kind":'), quoted("input_kind"),
        F.lit("}"),
    )
    return F.sha2(text, 256)


Scorer = Callable[[DataFrame], DataFrame]


def score_requests(
    classified: DataFrame, scorers: dict[int, tuple[str, str, Scorer]]
) -> DataFrame:
    """Responses for every request; rejected ones keep their code.

    ``scorers`` maps a horizon to (model, configuration id, function), where the
    function adds a ``forecast_quantity`` column to rows with features.
    """
    echo = ["SKU_ID", "Warehouse_ID", "forecast_origin", "horizon", "input_kind"]
    out = classified.where(F.col("rejection").isNotNull()).select(
        *echo, F.col("rejection").alias("reason_code"), F.lit("rejected").alias("status")
    )
    ready = request_features(classified.where(F.col("rejection").isNull()))
    for horizon, (model, configuration, scorer) in sorted(scorers.items()):
        scored = scorer(ready.where(F.col("horizon") == horizon))
        quantity = F.col("forecast_quantity")
        usable = finite(quantity)
        branch = scored.select(
            *echo,
            F.when(~usable, "unavailable_forecast").alias("reason_code"),
            F.when(usable, "available").otherwise("unavailable").alias("status"),
            F.date_add("_origin", 1).alias("target_start_date"),
            F.date_add("_origin", F.lit(horizon)).alias("target_end_date"),
            forecast_type(F.lit(horizon)).alias("forecast_type"),
            F.when(usable, quantity).alias("forecast_quantity"),
            F.lit(model).alias("model"),
            F.lit(configuration).alias("configuration_id"),
            input_hash(scored).alias("input_sha256"),
        )
        out = out.unionByName(branch, allowMissingColumns=True)
    return out


def changed_history(requests: DataFrame, increment: float = 10.0) -> DataFrame:
    """Requests with the last day's quantity raised by a constant."""
    newest = F.array_max(F.transform("history", lambda e: e["Date"]))

    def raised(day: Column) -> Column:
        return F.transform(
            "history",
            lambda e: F.struct(
                e["Date"].alias("Date"),
                F.when(e["Date"] == day, e["Units_Sold"] + increment)
                .otherwise(e["Units_Sold"])
                .alias("Units_Sold"),
            ),
        )

    # the newest day is bound once per request, not looked for again at every entry
    return requests.withColumn("history", F.element_at(F.transform(F.array(newest), raised), 1))


# fixed values: keys a response may carry, and keys it may never carry
RESPONSE_KEYS = (
    "SKU_ID", "Warehouse_ID", "forecast_origin", "horizon", "input_kind", "reason_code",
    "status", "target_start_date", "target_end_date", "forecast_type", "forecast_quantity",
    "model", "configuration_id", "input_sha256",
)
FORBIDDEN_KEYS = ("observed_target", "actual_units_sold", "demand_forecast", "stockout_flag")


def response_rules(responses: DataFrame) -> dict[str, tuple[Column, list[str]]]:
    """Named conformance rules with the requirements they support."""
    ok = F.col("status") == "available"
    origin = strict_date("forecast_origin")
    keys = F.json_object_keys(F.to_json(F.struct(*responses.columns)))
    return {
        "identity_echo": (F.col("SKU_ID").isNotNull() & F.col("Warehouse_ID").isNotNull(), ["identity"]),
        "start_day": (~ok | (F.col("target_start_date") == F.date_add(origin, 1)), ["window"]),
        "end_day": (~ok | (F.col("target_end_date") == F.date_add(origin, F.col("horizon"))), ["window"]),
        "type_by_horizon": (~ok | (F.col("forecast_type") == forecast_type()), ["window", "quantity"]),
        "finite_quantity": (~ok | finite("forecast_quantity"), ["quantity"]),
        "hash_form": (~ok | F.col("input_sha256").rlike("^[0-9a-f]{64}$"), ["provenance"]),
        "allowed_keys": (
            F.size(F.array_except(keys, F.array(*[F.lit(k) for k in RESPONSE_KEYS]))) == 0,
            ["leakage"],
        ),
        "no_forbidden_key": (
            ~F.arrays_overlap(
                F.transform(keys, F.lower), F.array(*[F.lit(k) for k in FORBIDDEN_KEYS])
            ),
            ["leakage"],
        ),
        "rejections_have_code": (
            ~(F.col("status") == "rejected") | F.col("reason_code").isin(*REJECTIONS),
            ["rejection"],
        ),
    }


