"""Daily demand panels derived from the transaction tables.

A panel has one row per (SKU_ID, Warehouse_ID, Date).  After the daily
aggregation a series is never longer than its calendar, so every later
``Window.partitionBy(series)`` works on a bounded group, however skewed the
underlying transaction log is: the aggregation itself combines map-side.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.fixed import PANEL_COLUMNS, SERIES
from shelfline.session import published

FULL_START = date(1997, 1, 1)
FULL_END = date(1997, 12, 30)


# Declared so that opening a table needs no schema-inference job.
TABLES = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def day_no(c: str = "Date") -> Column:
    """Days since the epoch; the integer axis of all calendar frames."""
    return F.unix_date(F.col(c)).cast("long")


def gap_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """returnflag x linestatus x day, missing days stay missing."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_returnflag").alias("SKU_ID"),
            F.col("l_linestatus").alias("Warehouse_ID"),
            F.to_date("l_shipdate").alias("Date"),
            "l_quantity",
        )
        .groupBy("SKU_ID", "Warehouse_ID", "Date")
        .agg(F.sum("l_quantity").cast("long").alias("Units_Sold"))
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event type x day, counted."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("SKU_ID"), F.to_date("ts").alias("Date"))
        .groupBy("SKU_ID", "Date")
        .agg(F.count(F.lit(1)).alias("Units_Sold"))
        .select("SKU_ID", F.lit("all").alias("Warehouse_ID"), "Date", "Units_Sold")
    )


def warehouse_of_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier key to region name: the dimension side of the panel log."""
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", "s_nationkey")
        .join(
            table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
            F.col("s_nationkey") == F.col("n_nationkey"),
        )
        .join(
            table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
            F.col("n_regionkey") == F.col("r_regionkey"),
        )
        .select("s_suppkey", F.col("r_name").alias("Warehouse_ID"))
    )


def whole_span(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last day of the whole log, as scalar subqueries."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return days.agg(F.min("d")).scalar(), days.agg(F.max("d")).scalar()


def sales_log(
    spark: SparkSession, sf_dir: str, start: date | None = FULL_START, end: date | None = FULL_END
) -> DataFrame:
    """Transactions of one scope, or all without bounds; date bounds reach the Parquet scan."""
    ship = F.col("l_shipdate")
    log = table(spark, sf_dir, "lineitem")
    if start is not None:
        log = log.where(ship >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    if end is not None:
        log = log.where(ship <= F.lit(f"{end} 23:59:59.999999").cast("timestamp_ntz"))
    return (
        log.select("l_partkey", "l_suppkey", "l_quantity", F.to_date(ship).alias("Date"))
        .join(
            table(spark, sf_dir, "part").select(
                "p_partkey", F.col("p_type").alias("SKU_ID")
            ),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .join(
            warehouse_of_supplier(spark, sf_dir),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .select("SKU_ID", "Warehouse_ID", "Date", "l_quantity")
    )


def observed_daily(
    spark: SparkSession, sf_dir: str, start: date | None = FULL_START, end: date | None = FULL_END
) -> DataFrame:
    """Days that had at least one transaction."""
    return (
        sales_log(spark, sf_dir, start, end)
        .groupBy("SKU_ID", "Warehouse_ID", "Date")
        .agg(F.sum("l_quantity").cast("long").alias("Units_Sold"))
    )


def spread_over_calendar(daily: DataFrame, start: date | Column, end: date | Column) -> DataFrame:
    """Turn a transaction log's day totals into a dense daily panel.

    Each observed day emits itself and the empty days before it (the last one
    also the days after it), so no spine join is needed and the result keeps
    the series partitioning for the windows that follow.
    """
    w = Window.partitionBy(*SERIES).orderBy("Date")
    start, end = (d if isinstance(d, Column) else F.lit(d) for d in (start, end))
    first = F.coalesce(F.date_add(F.lag("Date").over(w), 1), start)
    last = F.when(F.lead("Date").over(w).isNull(), end).otherwise(F.col("Date"))
    return (
        daily.withColumn("_first", first)
        .withColumn("_last", last)
        .select(
            "SKU_ID",
            "Warehouse_ID",
            F.col("Date").alias("_seen"),
            F.col("Units_Sold").alias("_units"),
            F.explode(F.sequence("_first", "_last")).alias("Date"),
        )
        .select(
            "SKU_ID",
            "Warehouse_ID",
            "Date",
            F.when(F.col("Date") == F.col("_seen"), F.col("_units"))
            .otherwise(F.lit(0).cast("long"))
            .alias("Units_Sold"),
        )
    )


def full_demand(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """part type x region x day over the panel year, or the whole log; no transaction = 0 units."""
    if whole:
        return spread_over_calendar(observed_daily(spark, sf_dir, None, None), *whole_span(spark, sf_dir))
    return spread_over_calendar(
        observed_daily(spark, sf_dir), FULL_START, FULL_END
    )


def published_demand(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """`full_demand` as a stored table for jobs that read it several times.

    Range partitioning by series keeps file sizes even whatever a series weighs.
    """
    return published(
        spark,
        f"demand:{sf_dir}:{whole}",
        [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "part", "supplier", "nation", "region")],
        lambda: full_demand(spark, sf_dir, whole).repartitionByRange(*SERIES, "Date"),
    )


def published_panel(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The 15-column panel over the stored demand table."""
    skus, warehouses = rank_tables(spark, sf_dir)
    return with_inventory(published_demand(spark, sf_dir, whole), skus, warehouses).select(*PANEL_COLUMNS)


def _rank_table(values: DataFrame, name: str, rank: str) -> DataFrame:
    # distinct values of one dimension: bounded by that dimension's cardinality
    return values.distinct().select(
        name, F.dense_rank().over(Window.orderBy(name)).cast("long").alias(rank)
    )


def with_inventory(demand: DataFrame, skus: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Attach the deterministic inventory, price and flag columns of the fixture."""
    n, sn, wn = F.col("_n"), F.col("_sn"), F.col("_wn")
    cost = (502 + (n + sn * 97 + wn * 31) % 1475) / F.lit(100.0)
    return (
        demand.join(skus, "SKU_ID")
        .join(warehouses, "Warehouse_ID")
        .withColumn("_n", day_no())
        .select(
            "Date",
            "SKU_ID",
            "Warehouse_ID",
            F.concat(F.lit("S"), (1 + (sn * 3 + wn) % 10).cast("string")).alias("Supplier_ID"),
            F.concat(F.lit("R"), (1 + wn % 4).cast("string")).alias("Region"),
            "Units_Sold",
            (168 + (n * 37 + sn * 101 + wn * 53) % 823).alias("Inventory_Level"),
            (2 + (n * 5 + sn * 3 + wn * 7) % 13).alias("Supplier_Lead_Time_Days"),
            (201 + (n * 17 + sn * 29 + wn * 71) % 198).alias("Reorder_Point"),
            F.when((n + sn * 7 + wn * 3) % 18 == 0, 1 + (n * 13 + sn) % 499)
            .otherwise(F.lit(0).cast("long"))
            .alias("Order_Quantity"),
            cost.alias("Unit_Cost"),
            (cost * 1.5).alias("Unit_Price"),
            F.when((n * 7 + sn * 3 + wn) % 10 == 0, 1).otherwise(0).alias("Promotion_Flag"),
            F.lit(0).alias("Stockout_Flag"),
            F.greatest(F.lit(0), F.col("Units_Sold") + (n + sn + wn) % 5 - 2)
            .cast("double")
            .alias("Demand_Forecast"),
        )
    )


def rank_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    skus = _rank_table(
        table(spark, sf_dir, "part").select(F.col("p_type").alias("SKU_ID")), "SKU_ID", "_sn"
    )
    warehouses = _rank_table(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("Warehouse_ID")),
        "Warehouse_ID",
        "_wn",
    )
    return skus, warehouses


def full_panel(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The validated 15-column panel over the dense demand panel."""
    skus, warehouses = rank_tables(spark, sf_dir)
    return with_inventory(full_demand(spark, sf_dir, whole), skus, warehouses).select(*PANEL_COLUMNS)


def raw_panel(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The 15-column panel as source text, clean."""
    p = published_panel(spark, sf_dir, whole)
    return p.select(*[F.col(c).cast("string").alias(c) for c in PANEL_COLUMNS])


def raw_panel_with_defects(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Source text with every kind of defect, placed by a deterministic rule."""
    skus, warehouses = rank_tables(spark, sf_dir)
    demand = published_demand(spark, sf_dir, whole)
    keyed = (
        with_inventory(demand, skus, warehouses)
        .join(skus, "SKU_ID")
        .join(warehouses, "Warehouse_ID")
        .withColumn("_k", day_no() * 31 + F.col("_sn") * 7 + F.col("_wn"))
        .where(F.col("_k") % 271 != 0)
    )
    k = F.col("_k")

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    changes = {
        "Date": F.when(k % 211 == 0, F.concat(text("Date"), F.lit("x"))).otherwise(text("Date")),
        "SKU_ID": F.when(k % 223 == 0, F.concat(F.lit(" "), text("SKU_ID")))
        .when(k % 277 == 0, F.concat(text("SKU_ID"), F.lit("\t")))
        .otherwise(text("SKU_ID")),
        "Warehouse_ID": F.when(k % 227 == 0, F.lit("  "))
        .when(k % 281 == 0, F.lit("\t"))
        .otherwise(text("Warehouse_ID")),
        "Supplier_ID": F.when(k % 229 != 0, text("Supplier_ID")),
        "Units_Sold": F.when(k % 233 == 0, F.lit("abc"))
        .when(k % 239 == 0, F.lit("-3"))
        .when(k % 241 == 0, F.lit("2.5"))
        .when(k % 283 == 0, F.lit("5d"))
        .when(k % 293 == 0, F.lit("0x1p3"))
        .otherwise(text("Units_Sold")),
        "Inventory_Level": F.when(k % 251 == 0, F.lit("Infinity")).otherwise(
            text("Inventory_Level")
        ),
        "Promotion_Flag": F.when(k % 257 == 0, F.lit("2")).otherwise(text("Promotion_Flag")),
    }
    raw = keyed.select("_k", *[changes.get(c, text(c)).alias(c) for c in PANEL_COLUMNS])
    # one extra copy of some rows, and one conflicting copy of some others
    copies = F.when(k % 263 == 0, 2).when(k % 269 == 0, 2).otherwise(1)
    copied = raw.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    conflict = (k % 269 == 0) & (k % 263 != 0) & (F.col("_copy") == 2)
    return copied.withColumn(
        "Order_Quantity",
        F.when(conflict, F.lit("777")).otherwise(F.col("Order_Quantity")),
    ).select(*PANEL_COLUMNS)
