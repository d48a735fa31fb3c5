"""CSV text source and evidence tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.fixed import PANEL_COLUMNS
from shelfline.functions.expr import count_if, finite, strict_date
from shelfline.operators.quality import SourceDefects

NO_NULL = "\u0001"  # a marker no field can hold, so blanks stay blank text


def scan_scoped_csv(spark: SparkSession, path: str, start: date, end: date) -> DataFrame:
    """Source text of an inclusive date scope; every column stays text.

    The header must be exactly the fifteen names in any order.  A date that
    does not parse anywhere in the file blocks, because the scope could not be
    isolated safely.
    """
    if start > end:
        raise SourceDefects("scope boundaries are not ordered")
    raw = (
        spark.read.option("header", True)
        .option("nullValue", NO_NULL)
        .option("emptyValue", "")
        .option("encoding", "UTF-8")
        .csv(path)
    )
    names = [c.lstrip("﻿") for c in raw.columns]
    if len(names) != len(set(names)) or set(names) != set(PANEL_COLUMNS):
        raise SourceDefects("source header must match the unique full schema")
    raw = raw.toDF(*names).select(*PANEL_COLUMNS)
    day = strict_date("Date")
    if not raw.where(day.isNull()).isEmpty():
        raise SourceDefects("invalid dates prevent safe scope isolation")
    return raw.where(day.between(F.lit(start), F.lit(end)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("emptyValue", "").option(
        "nullValue", ""
    ).csv(path)


def sink_evidence_csv(df: DataFrame, columns: list[str], path: str, order: list[Column | str]) -> None:
    """Fixed-schema evidence table in protocol order; booleans as true/false."""
    shaped = []
    for name in columns:
        kind = dict(df.dtypes)[name]
        c = F.col(name)
        if kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        shaped.append(c.cast("string").alias(name))
    ranked = df.orderBy(*order).select(*shaped)
    write_csv(ranked, path)


def scan_evidence_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed evidence rows; blank is missing, malformed rows fail the read."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def nonfinite_cells(df: DataFrame) -> DataFrame:
    """Count of NaN or infinite cells per double column."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    wide = df.agg(*[count_if(F.col(c).isNotNull() & ~finite(c)).alias(c) for c in doubles])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nonfinite")) for c in doubles]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def sink_tables_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per profile table."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
