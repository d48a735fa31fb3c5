"""Column expressions that keep ANSI mode from raising on undefined values."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_date(text: Column | str) -> Column:
    """``yyyy-MM-dd`` text to a date; every other shape becomes NULL."""
    return F.to_date(F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd")))


# decimal and exponent forms and infinities; no type suffixes, no hexadecimal
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def number(text: Column | str) -> Column:
    """Text to double; unparsable text and NaN become NULL, infinities survive."""
    plain = F.when(col(text).cast("string").rlike(_NUMBER), col(text))
    parsed = plain.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def blank(c: Column | str) -> Column:
    """True for present text of nothing but white space, of any kind."""
    return F.coalesce(~col(c).cast("string").rlike(r"(?U)\S"), F.lit(False))


def finite(c: Column | str) -> Column:
    """True only for a present, non-NaN, non-infinite number."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(INF)), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(finite(c), c)


def clean_text(c: Column | str) -> Column:
    """True for present, non-blank, unpadded text."""
    return F.coalesce(col(c).rlike(r"(?sU)^\S(.*\S)?\z"), F.lit(False))


def whole_count(c: Column | str) -> Column:
    """A finite non-negative whole number as double, else NULL."""
    c = col(c).cast("double")
    return F.when(finite(c) & (c >= 0) & (c % 1 == 0), c)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` with NULL for a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share(condition: Column) -> Column:
    """Mean of a 0/1 condition; NULL input counts as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def pearson(x: Column | str, y: Column | str, at_least: int = 2) -> Column:
    """Pearson correlation over rows where both sides are present.

    Undefined (too few pairs, a constant side) is NULL instead of an ANSI error.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    defined = (
        (F.count(a) >= at_least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    )
    return F.when(defined, F.covar_samp(a, b) / F.nullif(spread, F.lit(0.0)))


def reasons(*conditional: Column) -> Column:
    """Ordered list of the reasons that apply, first occurrence kept."""
    return F.array_distinct(F.array_compact(F.array(*conditional)))


def all_of(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def any_of(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def explode_values(rows: list[tuple], names: list[str]) -> Column:
    """A literal table as an exploding generator: attaches every literal row
    to each input row without a join.

    The table travels as one JSON literal, which the optimizer folds into a
    constant array, so plans stay small however many rows it has.
    """
    kinds = {str: "STRING", int: "INT", float: "DOUBLE"}
    fields = ", ".join(f"{n}: {kinds[type(v)]}" for n, v in zip(names, rows[0]))
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return F.explode(F.from_json(F.lit(text), f"array<struct<{fields}>>"))


def unpivot_named(df, pairs: list[tuple[str, Column]], name: str, value: str, keep=()):
    """Wide one-row (or few-row) aggregate to ``(name, value)`` rows."""
    entries = F.array(
        *[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in pairs]
    )
    return df.select(*keep, F.explode(entries).alias("_e")).select(
        *keep, f"_e.{name}", f"_e.{value}"
    )
