"""Relations of half-open intervals, and differences of two snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError

#: The thirteen relations of intervals (s, e) and (s2, e2), each with s < e; of two intervals exactly one holds.
RELATIONS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "before": lambda s, e, s2, e2: e < s2,
    "after": lambda s, e, s2, e2: s > e2,
    "meets": lambda s, e, s2, e2: e == s2,
    "met_by": lambda s, e, s2, e2: s == e2,
    "overlaps": lambda s, e, s2, e2: (s < s2) & (s2 < e) & (e < e2),
    "overlapped_by": lambda s, e, s2, e2: (s2 < s) & (s < e2) & (e2 < e),
    "starts": lambda s, e, s2, e2: (s == s2) & (e < e2),
    "started_by": lambda s, e, s2, e2: (s == s2) & (e > e2),
    "during": lambda s, e, s2, e2: (s > s2) & (e < e2),
    "contains": lambda s, e, s2, e2: (s < s2) & (e > e2),
    "finishes": lambda s, e, s2, e2: (e == e2) & (s > s2),
    "finished_by": lambda s, e, s2, e2: (e == e2) & (s < s2),
    "equals": lambda s, e, s2, e2: (s == s2) & (e == e2),
}


def related(left: DataFrame, right: DataFrame, relation: str, on: list[str], interval: tuple[str, str], condition: Column | None = None) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose intervals stand in the relation; columns come back as structs l and r.

    The equi-key carries the join (hash or sort-merge, skew split by AQE); the relation
    is its residual.  Null keys and null bounds relate to nothing.
    """
    a, b = (df.select(*(F.col(c).alias(f"_k{i}{p}") for i, c in enumerate(on)), F.struct("*").alias(p)) for df, p in ((left, "l"), (right, "r")))
    s, e = interval
    holds = RELATIONS[relation](F.col(f"l.{s}"), F.col(f"l.{e}"), F.col(f"r.{s}"), F.col(f"r.{e}"))
    keys = [F.col(f"_k{i}l") == F.col(f"_k{i}r") for i in range(len(on))]
    return a.join(b, [*keys, holds, *([] if condition is None else [condition])]).select("l", "r")


def concurrent(a: Column, b: Column, seconds: float) -> Column:
    """Whether two times are at most so many seconds apart."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) <= int(seconds * 1_000_000)


def added(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the new snapshot whose key isn't in the old one (swap the snapshots for removed ones)."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def changed(old: DataFrame, new: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, old_value, new_value of rows in both snapshots whose column differs (a null equals a null only)."""
    was, now = old.select(*key, F.col(column).alias("old_value")), new.select(*key, F.col(column).alias("new_value"))
    return was.join(now, key).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def role_drift(old: DataFrame, new: DataFrame, key: list[str], role: str, was: str, now: str) -> DataFrame:
    """Keys whose role was ``was`` in the old snapshot and is ``now`` in the new one; of several rows of a key any counts."""
    before, after = old.filter(F.col(role) == was).select(key).distinct(), new.filter(F.col(role) == now).select(key).distinct()
    return before.join(after, key, "left_semi")


#: Ways a changed property may have changed.
DIRECTIONS: dict[str, Callable[[Column, Column], Column]] = {"any": lambda a, b: ~a.eqNullSafe(b), "up": lambda a, b: b > a, "down": lambda a, b: b < a}


def changed_towards(old: DataFrame, new: DataFrame, key: list[str], column: str, direction: str = "any") -> DataFrame:
    """``changed`` in one direction."""
    return changed(old, new, key, column).filter(DIRECTIONS[direction](F.col("old_value"), F.col("new_value")))


@dataclass(frozen=True)
class TimeWindow:
    """The rows before a row that an aggregate sees, by time.

    ``rolling(n, unit)`` takes those less than n units before it and the row itself,
    ``trailing(n, unit)`` those of the n whole units before the row's own, ``ytd``,
    ``qtd`` and ``mtd`` those since the start of its year, quarter or month,
    ``period(first, last)`` all rows of a fixed period, last excluded.
    """

    kind: str
    n: int = 0
    unit: str = "day"
    first: str = ""
    last: str = ""

    def sql(self, fn: str, measure: str, ts: str, partition: list[str]) -> str:
        """An SQL window expression."""
        by = ", ".join(partition)
        if self.kind == "period":
            inside = f"{ts} >= timestamp_ntz'{self.first}' AND {ts} < timestamp_ntz'{self.last}'"
            return f"{fn}(CASE WHEN {inside} THEN {measure} END) OVER ({f'PARTITION BY {by}' if by else ''})"
        if self.kind in ("ytd", "qtd", "mtd"):
            start = f"date_trunc('{ {'y': 'year', 'q': 'quarter', 'm': 'month'}[self.kind[0]] }', {ts})"
            return f"{fn}({measure}) OVER (PARTITION BY {', '.join([*partition, start])} ORDER BY {ts})"
        if self.kind == "rolling":
            frame, order = f"INTERVAL '{self.n}' {self.unit} PRECEDING AND CURRENT ROW", ts
            seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}.get(self.unit.lower())
            if seconds:  # less than n units: the row just n units before is out
                frame = f"INTERVAL '{self.n * seconds - 1}.999999' second PRECEDING AND CURRENT ROW"
        elif self.kind == "trailing":
            order = f"cast(date_trunc('{self.unit}', {ts}) as timestamp_ntz)"
            frame = f"INTERVAL '{self.n}' {self.unit} PRECEDING AND INTERVAL '1' {self.unit} PRECEDING"
        else:
            raise SemanticError(f"no time window {self.kind!r}")
        part = f"PARTITION BY {by} " if by else ""
        return f"{fn}({measure}) OVER ({part}ORDER BY {order} RANGE BETWEEN {frame})"


def rolling(n: int, unit: str = "day") -> TimeWindow:
    return TimeWindow("rolling", n, unit)


def trailing(n: int, unit: str = "day") -> TimeWindow:
    return TimeWindow("trailing", n, unit)


def period(first: str, last: str) -> TimeWindow:
    return TimeWindow("period", first=first, last=last)


YTD, QTD, MTD = TimeWindow("ytd"), TimeWindow("qtd"), TimeWindow("mtd")
