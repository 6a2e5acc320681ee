"""Column functions on lists, structs, dates, bits and text, as SQL engines of analytics name them; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


# lists and structs

def list_first(a: Name) -> Column:
    """Null for an empty list."""
    return F.get(_c(a), F.lit(0))


def list_last(a: Name) -> Column:
    """Null for an empty list."""
    return F.get(_c(a), F.size(_c(a)) - 1)


def list_count(a: Name) -> Column:
    """0 for a null list."""
    return F.greatest(F.size(_c(a)), F.lit(0)).cast("bigint")


def list_sum(a: Name) -> Column:
    """The sum of the numbers in a list, nulls left out, as a bigint for whole numbers and a double for others; 0 for none."""
    plain = F.filter(_c(a), lambda x: x.isNotNull())
    return F.aggregate(F.transform(plain, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def list_appended(a: Name, x: Name) -> Column:
    """A null list counts as empty."""
    return F.concat(F.coalesce(_c(a), F.array()), F.array(_c(x)))


def int_range(start: int, stop: int) -> Column:
    """start to stop, stop excluded."""
    return F.sequence(F.lit(start), F.lit(stop - 1)) if stop > start else F.array().cast("array<int>")


def field(s: Name, name: str) -> Column:
    return _c(s)[name]


def unnested(df: DataFrame, a: str, name: str, position: str | None = None) -> DataFrame:
    """A row for each element; rows with empty or null lists go.  ``position`` names a column with its place, from 1 on."""
    rest = [c for c in df.columns if c != a]
    if position is None:
        return df.select(*rest, F.explode(a).alias(name))
    return df.select(*rest, F.posexplode(a).alias(position, name)).withColumn(position, F.col(position) + 1)


def listed(df: DataFrame, by: list[str], column: str, order: str, name: str) -> DataFrame:
    """(*by, name): the values of each group in an order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


# dates

def days_between(first: Name, last: Name) -> Column:
    """Midnights from one time to the other."""
    return F.date_diff(F.to_date(_c(last)), F.to_date(_c(first))).cast("bigint")


def units_between(unit: str, first: Name, last: Name) -> Column:
    """Starts of a unit (month, quarter, year) that are passed from one time to the other."""
    months = lambda c: F.year(c) * 12 + F.month(c) - 1
    size = {"month": 1, "quarter": 3, "year": 12}[unit]
    at = lambda c: F.floor(months(_c(c)) / size)
    return (at(last) - at(first)).cast("bigint")


def truncated(unit: str, c: Name) -> Column:
    return F.date_trunc(unit, _c(c)).cast("timestamp_ntz")


def try_cast(c: str, kind: str) -> Column:
    """Null where the value doesn't fit."""
    return F.expr(f"try_cast(`{c}` as {kind})")


# bits

def bits_set(c: Name) -> Column:
    return F.bit_count(_c(c)).cast("bigint")


def bit_is_set(c: Name, bit: int) -> Column:
    return F.shiftright(_c(c), bit).bitwiseAND(F.lit(1)) == 1


def bit_mask(*bits: int) -> int:
    """The number with these bits."""
    return sum(1 << b for b in set(bits))


# text

def matches(c: Name, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return _c(c).rlike(pattern)


def formatted(pattern: str, *columns: Name) -> Column:
    return F.format_string(pattern, *map(_c, columns))


def differs(a: Name, b: Name) -> Column:
    """Null-safe: a null equals a null only."""
    return ~_c(a).eqNullSafe(_c(b))
