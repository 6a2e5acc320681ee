"""Column transforms that chain, and pipelines of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TransformTypeError


class Transform:
    """Steps on one column: ``on("name").strip().upper()``."""

    #: What kind of column a step takes.
    TEXT = ("lower", "upper", "strip", "replace_all", "slice", "to_date", "to_datetime")

    def __init__(self, column: str, steps: tuple = (), dropping: bool = False):
        self.column, self.steps, self.dropping = column, steps, dropping

    def _then(self, name: str, f: Callable[[Column], Column]) -> Transform:
        return Transform(self.column, (*self.steps, (name, f)), self.dropping)

    def lower(self):
        return self._then("lower", F.lower)

    def upper(self):
        return self._then("upper", F.upper)

    def strip(self):
        return self._then("strip", F.trim)

    def replace_all(self, old: str, new: str):
        """Plain text, not a pattern."""
        return self._then("replace_all", lambda c: F.replace(c, F.lit(old), F.lit(new)))

    def slice(self, start: int, length: int):
        """Characters from a 0-based start."""
        return self._then("slice", lambda c: F.substring(c, start + 1, length))

    def cast(self, kind: str):
        return self._then("cast", lambda c: c.try_cast(kind))

    def fill_null(self, value):
        return self._then("fill_null", lambda c: F.coalesce(c, F.lit(value)))

    def is_null(self):
        return self._then("is_null", lambda c: c.isNull())

    def to_date(self, form: str):
        return self._then("to_date", lambda c: F.to_date(F.try_to_timestamp(c, F.lit(form))))

    def to_datetime(self, form: str):
        return self._then("to_datetime", lambda c: F.try_to_timestamp(c, F.lit(form)))

    def drop_nulls(self):
        return Transform(self.column, self.steps, True)


def on(column: str) -> Transform:
    return Transform(column)


def apply(df: DataFrame, transforms: list[Transform]) -> DataFrame:
    """Each transform replaces its column; a first step for text on another type is an error before anything runs."""
    kinds = dict(df.dtypes)
    for t in transforms:
        if t.column not in kinds:
            raise TransformTypeError(f"no column {t.column}")
        if t.steps and t.steps[0][0] in Transform.TEXT and kinds[t.column] != "string":
            raise TransformTypeError(f"{t.steps[0][0]} takes text, {t.column} is {kinds[t.column]}")
        made = F.col(t.column)
        for _, f in t.steps:
            made = f(made)
        df = df.withColumn(t.column, made)
        if t.dropping:
            df = df.filter(F.col(t.column).isNotNull())
        kinds = dict(df.dtypes)
    return df


def apply_sql(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Named columns replaced by SQL expressions, all over the input's columns."""
    return df.withColumns({c: F.expr(e) for c, e in expressions.items()})
