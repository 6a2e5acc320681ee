"""Made-up tables by declaration, generated by Spark: the same seed gives the same rows at any number of partitions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SchemaError


@dataclass(frozen=True)
class FieldSpec:
    """A column: kind is sequence, integer, decimal, choice, text, date, boolean, reference or null."""

    name: str
    kind: str
    low: float = 0
    high: float = 100
    choices: tuple = ()
    weights: tuple[float, ...] = ()
    pattern: str = ""
    of: str = ""
    null_rate: float = 0.0

    def column(self, entity: str, seed: int, sizes: dict[str, int]) -> Column:
        u = _share("id", f"{entity}.{self.name}", seed)
        if self.kind == "sequence":
            out = F.col("id") + int(self.low)
        elif self.kind == "integer":
            out = (F.lit(int(self.low)) + F.floor(u * (int(self.high) - int(self.low) + 1))).cast("bigint")
        elif self.kind == "decimal":
            out = F.round(self.low + u * (self.high - self.low), 2)
        elif self.kind == "boolean":
            out = u < (self.weights[0] if self.weights else 0.5)
        elif self.kind == "choice":
            weights = self.weights or (1.0,) * len(self.choices)
            out, total, at = F.lit(self.choices[-1]), sum(weights), sum(weights)
            for value, w in list(zip(self.choices, weights, strict=True))[::-1]:
                out = F.when(u * total < at, F.lit(value)).otherwise(out)
                at -= w
        elif self.kind == "text":
            out = F.format_string(self.pattern or f"{self.name}-%d", F.col("id"))
        elif self.kind == "date":
            out = F.date_add(F.lit(self.pattern or "2024-01-01").cast("date"), (F.lit(int(self.low)) + F.floor(u * (int(self.high) - int(self.low) + 1))).cast("int"))
        elif self.kind == "reference":
            if self.of not in sizes:
                raise SchemaError(f"{entity}.{self.name} refers to {self.of}, which comes later or not at all")
            out = F.floor(u * sizes[self.of]).cast("bigint")
        elif self.kind == "null":
            out = F.lit(None).cast("string")
        else:
            raise SchemaError(f"no kind of field {self.kind!r}")
        return out if not self.null_rate else F.when(_share("id", f"null {entity}.{self.name}", seed) >= self.null_rate, out)


def _share(key: str, salt: str, seed: int) -> Column:
    """A number from 0 to 1 (excluded) that the row's key, the salt and the seed determine."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(salt), F.lit(seed)), 11) / F.lit(float(1 << 53))


@dataclass(frozen=True)
class ChangeRule:
    """A share of an entity's rows changes a column to an expression, or (column None) goes."""

    share: float
    column: str | None = None
    value: str = ""


@dataclass(frozen=True)
class EntitySchema:
    name: str
    rows: int
    fields: tuple[FieldSpec, ...]
    changes: tuple[ChangeRule, ...] = ()


@dataclass(frozen=True)
class EventSpec:
    """Events of an entity's rows: so many a row in the mean, of kinds by weight, within days from a start."""

    name: str
    entity: str
    per_row: float
    kinds: tuple[str, ...]
    weights: tuple[float, ...] = ()
    start: str = "2024-01-01"
    days: int = 30


@dataclass
class Dataset:
    entities: list[EntitySchema]
    events: list[EventSpec] = field(default_factory=list)
    seed: int = 42

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        sizes: dict[str, int] = {}
        out = {}
        for e in self.entities:
            rows = spark.range(e.rows)
            out[e.name] = rows.select(*(f.column(e.name, self.seed, sizes).alias(f.name) for f in e.fields))
            sizes[e.name] = e.rows
        for ev in self.events:
            if ev.entity not in sizes:
                raise SchemaError(f"{ev.name} is of {ev.entity}, which isn't there")
            n = int(round(sizes[ev.entity] * ev.per_row))
            key = FieldSpec("entity_id", "reference", of=ev.entity)
            kind = FieldSpec("kind", "choice", choices=ev.kinds, weights=ev.weights)
            at = F.timestamp_seconds(F.unix_seconds(F.lit(ev.start).cast("timestamp")) + F.floor(_share("id", f"{ev.name}.at", self.seed) * ev.days * 86400)).cast("timestamp_ntz")
            out[ev.name] = spark.range(n).select(F.col("id").alias("event_id"), key.column(ev.name, self.seed, sizes).alias("entity_id"), kind.column(ev.name, self.seed, sizes).alias("kind"), at.alias("at"))
        return out

    def changed(self, spark: SparkSession, name: str, turn: int) -> DataFrame:
        """The entity's rows as of a later turn: its rules applied ``turn`` times, to other rows each time."""
        e = next(x for x in self.entities if x.name == name)
        key = next(f.name for f in e.fields if f.kind == "sequence")
        df = self.frames(spark)[name]
        for t in range(1, turn + 1):
            for i, r in enumerate(e.changes):
                hit = _share(key, f"change {i} {t}", self.seed) < r.share
                df = df.filter(~hit) if r.column is None else df.withColumn(r.column, F.when(hit, F.expr(r.value)).otherwise(F.col(r.column)))
        return df
