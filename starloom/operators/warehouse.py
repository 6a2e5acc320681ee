"""Loading a star schema: fact strategies by declaration, dimensions before facts, keys resolved, order from references."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KeyResolutionError, LoadError, SchemaError
from ..sources.table import VersionedTable
from . import loaders

LAYERS = ("dimension", "fact", "bridge", "graph")


@dataclass(frozen=True)
class Reference:
    """A column of a source that names a member of a dimension by its natural key."""

    column: str
    dimension: str
    key: str
    sk: str = "id"
    name: str = ""
    at: str | None = None
    missing: str = "infer"  # or "raise", or "null"


@dataclass(frozen=True)
class Entity:
    """A table of the schema.  ``options`` go to its strategy or dimension type."""

    name: str
    kind: str = "fact"
    strategy: str | None = None
    key: tuple[str, ...] = ()
    tracked: tuple = ()
    references: tuple[Reference, ...] = ()
    options: dict = field(default_factory=dict)


#: name -> change(table, rows, entity, as_of, change id)
STRATEGIES: dict[str, Callable] = {
    "append": lambda t, rows, e, as_of, change: t.write(rows, change),
    "snapshot": lambda t, rows, e, as_of, change: t.write(loaders.with_snapshot_date(rows, as_of[:10], **e.options), change),
    "accumulating": lambda t, rows, e, as_of, change: t._changed(lambda now: loaders.accumulate(now, rows, list(e.key), **e.options), change),
    "upsert": lambda t, rows, e, as_of, change: t._changed(lambda now: loaders.upsert(now, rows, list(e.key), **e.options), change),
    "merge": lambda t, rows, e, as_of, change: t.merge(rows, list(e.key), list(e.tracked), as_of, change),
    "scd1": lambda t, rows, e, as_of, change: t.scd(1, rows, list(e.key), e.tracked, as_of, change, **e.options),
    "scd2": lambda t, rows, e, as_of, change: t.scd(2, rows, list(e.key), e.tracked, as_of, change, **e.options),
    "scd3": lambda t, rows, e, as_of, change: t.scd(3, rows, list(e.key), e.tracked, as_of, change, **e.options),
    "scd6": lambda t, rows, e, as_of, change: t.scd(6, rows, list(e.key), e.tracked, as_of, change, **e.options),
}


def inferred_strategy(e: Entity) -> str:
    """The strategy that a declaration implies where it names none."""
    if e.strategy:
        if e.strategy not in STRATEGIES:
            raise LoadError(f"no strategy {e.strategy!r}")
        return e.strategy
    if e.kind == "dimension":
        return "scd2" if e.tracked else "upsert"
    if "milestones" in e.options:
        return "accumulating"
    if "column" in e.options:
        return "snapshot"
    return "upsert" if e.key else "append"


def build_order(entities: list[Entity]) -> list[Entity]:
    """Layer by layer (dimension, fact, bridge, graph), and within a layer after what is referred to; cycles are an error."""
    by_name = {e.name: e for e in entities}
    if len(by_name) != len(entities):
        raise SchemaError("two entities have one name")
    for e in entities:
        if e.kind not in LAYERS:
            raise SchemaError(f"{e.name}: no layer {e.kind!r}")
        for r in e.references:
            if r.dimension not in by_name:
                raise SchemaError(f"{e.name} refers to {r.dimension}, which isn't declared")
            if LAYERS.index(by_name[r.dimension].kind) > LAYERS.index(e.kind):
                raise SchemaError(f"{e.name} refers to {r.dimension} of a later layer")
    out: list[Entity] = []
    left = sorted(entities, key=lambda e: (LAYERS.index(e.kind), e.name))
    while left:
        done = {e.name for e in out}
        ready = [e for e in left if all(r.dimension in done or r.dimension == e.name for r in e.references)]
        if not ready:
            raise SchemaError("references in a circle: " + ", ".join(e.name for e in left))
        first = min(LAYERS.index(e.kind) for e in left)
        now = [e for e in ready if LAYERS.index(e.kind) == first] or ready
        out += now
        left = [e for e in left if e not in now]
    return out


class Resolver:
    """Surrogate keys of one reference: resolved by a join, missing members inferred once a batch."""

    def __init__(self, table: VersionedTable, reference: Reference, inferred: Callable[[str, int], None] | None = None):
        self.table, self.r, self.inferred = table, reference, inferred

    def __call__(self, rows: DataFrame, as_of: str, change: str) -> DataFrame:
        r, known = self.r, self.table.read()
        if r.missing != "null":
            asked = rows.select(F.col(r.column).alias("_k")).filter("_k is not null").distinct()
            missing = asked.join(known.select(F.col(r.key).alias("_k")), "_k", "left_anti")
            n = missing.count()
            if n and r.missing == "raise":
                raise KeyResolutionError(f"{n} values of {r.column} are not in {r.dimension}")
            if n:
                self.table.overwrite(loaders.infer_members(rows, known, r.column, r.key, r.sk, as_of), f"{r.column}-inferred-{change}")
                known = self.table.read()
                if self.inferred:
                    self.inferred(r.dimension, n)
        return loaders.resolve(rows, known, [(r.column, r.key)], r.sk, r.name or f"{r.column}_sk", r.at)


@dataclass
class Loaded:
    entity: str
    strategy: str
    rows: int
    version: int


class Warehouse:
    """Tables of declared entities and their loads, in build order."""

    def __init__(self, entities: list[Entity], tables: Callable[[str], VersionedTable], events: Callable[[str, dict], None] | None = None):
        self.order = build_order(entities)
        self.tables = {e.name: tables(e.name) for e in self.order}
        self.events = events or (lambda kind, details: None)

    def load(self, batches: dict[str, DataFrame], as_of: str, change: str) -> list[Loaded]:
        """One batch of some entities.  ``change`` names the batch: what of it is in already isn't loaded twice."""
        unknown = set(batches) - set(self.tables)
        if unknown:
            raise LoadError(f"not declared: {', '.join(sorted(unknown))}")
        out = []
        for e in self.order:
            if e.name not in batches:
                continue
            rows, strategy, table = batches[e.name], inferred_strategy(e), self.tables[e.name]
            for r in e.references:
                rows = Resolver(self.tables[r.dimension], r, lambda d, n: self.events("inferred", {"dimension": d, "members": n}))(rows, as_of, f"{e.name}-{change}")
            self.events("started", {"entity": e.name, "strategy": strategy})
            first = not table.versions()
            version = table.write(rows, change) if first and strategy in ("append", "upsert") else STRATEGIES[strategy](table, rows, e, as_of, change)
            out.append(Loaded(e.name, strategy, rows.count(), version))
            self.events("finished", {"entity": e.name, "strategy": strategy, "version": version})
        return out
