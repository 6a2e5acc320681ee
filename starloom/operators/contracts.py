"""Data contracts: rules, a report of their violations, schema evolution, and quality gates.

All rules on single rows share one aggregation over the table; rules on keys and on
versions add one each.  A report has a row (rule, severity, violations, detail) for
every violated rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    """``violations`` is an aggregate over all rows, or a function of the table that returns one row with the column violations."""

    name: str
    detail: str
    violations: Column | Callable[[DataFrame], DataFrame]
    severity: str = ERROR


def _number(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("bigint")


def not_null(column: str) -> Rule:
    return Rule("NOT_NULL", f"column={column}", _number(F.col(column).isNull()))


def null_rate(column: str, most: float) -> Rule:
    """Nulls, if their share is above ``most``."""
    n = _number(F.col(column).isNull())
    return Rule("NULL_RATE", f"column={column}, max_pct={most}", F.when(n > most * F.count("*"), n).otherwise(0), WARNING)


def value_range(column: str, least=None, most=None) -> Rule:
    """Values below the least or above the most; nulls are none."""
    out = F.lit(False)
    if least is not None:
        out = out | (F.col(column) < least)
    if most is not None:
        out = out | (F.col(column) > most)
    return Rule("VALUE_RANGE", f"column={column}, min={least}, max={most}", _number(out))


def regex_match(column: str, pattern: str) -> Rule:
    """Values in which the pattern isn't found; nulls are none."""
    return Rule("REGEX_MATCH", f"column={column}, pattern={pattern}", _number(~F.col(column).rlike(pattern)), WARNING)


def row_count(least: int = 0, most: int | None = None) -> Rule:
    n = F.count("*")
    return Rule("ROW_COUNT", f"min={least}, max={most}", F.when((n < least) | ((n > most) if most is not None else F.lit(False)), F.greatest(n, F.lit(1))).otherwise(0))


def row_count_delta(previous: int, most: float) -> Rule:
    """The change of the row count, if it is more than that share of the previous one."""
    change = F.abs(F.count("*") - previous)
    return Rule("ROW_COUNT_DELTA", f"previous={previous}, max_pct={most}", F.when(change > most * previous, change).otherwise(0), WARNING)


def freshness(column: str, hours: float, as_of: str) -> Rule:
    """1 if the latest time is older than that (or there is none)."""
    old = F.max(column) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})")
    return Rule("FRESHNESS", f"column={column}, hours={hours}", F.when(F.coalesce(old, F.lit(True)), 1).otherwise(0), WARNING)


def no_duplicates(*columns: str) -> Rule:
    """Rows beyond the first of each key."""
    return Rule("NO_DUPLICATES", f"column={', '.join(columns)}", lambda df: df.groupBy(*columns).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))


def scd2_invariants(key: str) -> Rule:
    """More than one current row of a key; current rows with an end or without a start; closed ones without an end or not after their start."""
    now, start, end = F.col("is_current"), F.col("valid_from"), F.col("valid_to")
    wrong = (now & start.isNull()).cast("int") + (now & end.isNotNull()).cast("int") + (~now & end.isNull()).cast("int") + F.coalesce((~now & (start >= end)).cast("int"), F.lit(0))

    def run(df):
        of_key = df.groupBy(key).agg(F.greatest(F.sum(now.cast("int")) - 1, F.lit(0)).alias("more"), F.sum(wrong).alias("wrong"))
        return of_key.agg(F.coalesce(F.sum(F.col("more") + F.col("wrong")), F.lit(0)).alias("violations"))

    return Rule("SCD2_INVARIANTS", f"key={key}", run)


def no_orphan_versions(key: str) -> Rule:
    """Keys that have closed rows only."""
    return Rule("NO_ORPHAN_VERSIONS", f"key={key}", lambda df: df.groupBy(key).agg(F.bool_or("is_current").alias("now")).agg(_number(~F.col("now")).alias("violations")))


def monotonic_valid_from(key: str) -> Rule:
    """Keys with a closed row that starts after the current one."""
    now = F.col("is_current")
    return Rule("MONOTONIC_VALID_FROM", f"key={key}", lambda df: df.groupBy(key).agg(F.max(F.when(~now, F.col("valid_from"))).alias("h"), F.min(F.when(now, F.col("valid_from"))).alias("c")).agg(_number(F.col("h") > F.col("c")).alias("violations")))


def no_gap_periods(key: str) -> Rule:
    """Versions whose end isn't the next one's start."""
    following = F.lead("valid_from").over(W.partitionBy(key).orderBy("valid_from"))
    return Rule("NO_GAP_PERIODS", f"key={key}", lambda df: df.select("valid_to", following.alias("next")).agg(_number(F.col("valid_to") != F.col("next")).alias("violations")), WARNING)


def hash_consistency(column: str, tracked: list[str]) -> Rule:
    """Rows whose stored md5 isn't that of the tracked columns, joined by | (a null is empty)."""
    made = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tracked)))
    return Rule("HASH_CONSISTENCY", f"column={column}", _number(~F.col(column).eqNullSafe(made)), WARNING)


def column_exists(column: str) -> Rule:
    return Rule("COLUMN_EXISTS", f"column={column}", lambda df: df.sparkSession.range(1).select(F.lit(int(column not in df.columns)).alias("violations")))


def type_match(column: str, kind: str) -> Rule:
    return Rule("TYPE_MATCH", f"column={column}, type={kind}", lambda df: df.sparkSession.range(1).select(F.lit(int(dict(df.dtypes).get(column) != kind)).alias("violations")))


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, violations, detail) of each violated rule."""
    def named(r: Rule, n: Column) -> Column:
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), n.cast("bigint").alias("violations"), F.lit(r.detail).alias("detail"))

    rowwise = [r for r in rules if isinstance(r.violations, Column)]
    parts = [f.violations(df).select(named(f, F.col("violations")).alias("r")).select("r.*") for f in rules if f not in rowwise]
    if rowwise:
        one = df.agg(*(r.violations.alias(f"_{i}") for i, r in enumerate(rowwise)))
        parts.insert(0, one.select(F.explode(F.array(*(named(r, F.col(f"_{i}")) for i, r in enumerate(rowwise)))).alias("r")).select("r.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, severity string, violations bigint, detail string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.filter("violations > 0")


@dataclass
class Evolution:
    """Changes of a schema as (change, column): safe, additive (need a migration), and breaking ones."""

    safe: list[tuple[str, str]] = field(default_factory=list)
    additive: list[tuple[str, str]] = field(default_factory=list)
    breaking: list[tuple[str, str]] = field(default_factory=list)

    @property
    def is_safe(self) -> bool:
        return not (self.additive or self.breaking)


#: Each type is widened by those after it.
_WIDER = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


def evolution(old: T.StructType, new: T.StructType) -> Evolution:
    """Compares schemas: nullable columns may come freely, others and wider types need a migration, the rest breaks."""
    out, was, now = Evolution(), {f.name: f for f in old}, {f.name: f for f in new}
    for name, f in now.items():
        if name not in was:
            (out.safe if f.nullable else out.additive).append(("added", name))
            continue
        a, b = was[name].dataType.simpleString(), f.dataType.simpleString()
        if a != b:
            rank = next((w for w in _WIDER if a in w and b in w), None)
            if rank and rank.index(a) < rank.index(b):
                out.additive.append(("widened", name))
            else:
                out.breaking.append(("narrowed" if rank else "type_changed", name))
        if was[name].nullable and not f.nullable:
            out.breaking.append(("not_null", name))
    out.breaking += [("removed", name) for name in was if name not in now]
    return out


def gate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The table itself, if no rule of severity error is violated."""
    if bad := report(df, rules).filter(F.col("severity") == ERROR).collect():  # one row a rule at most
        raise ContractError("; ".join(f"{r.rule} ({r.detail}): {r.violations}" for r in bad))
    return df
