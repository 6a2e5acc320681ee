"""A schema as a graph: dimensions are vertices, facts and bridges tie them; reading, checking, drawing and comparing it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GrainCompatibilityError, SchemaError, SemanticError
from . import graph


@dataclass(frozen=True)
class Vertex:
    """A dimension: its table, surrogate key, natural key, and whether it keeps versions."""

    name: str
    table: str
    sk: str
    nk: tuple[str, ...] = ()
    versions: bool = False


@dataclass(frozen=True)
class EdgeType:
    """A fact or bridge between two dimensions.  Measures say whether they may be summed; ``time`` tells how fresh it is."""

    name: str
    table: str
    subject: str
    subject_key: str
    object: str
    object_key: str
    measures: dict[str, bool] = field(default_factory=dict, hash=False)
    grain: str | None = None
    time: str | None = None
    strategy: str = "append"
    directed: bool = True
    role: str | None = None


class SchemaGraph:
    def __init__(self, vertices: list[Vertex], edges: list[EdgeType]):
        self.vertices, self.edges = {v.name: v for v in vertices}, {e.name: e for e in edges}
        self._given = (len(vertices), len(edges))

    def validate(self) -> list[str]:
        """What is wrong, in words; nothing if the list is empty."""
        out = []
        if self._given != (len(self.vertices), len(self.edges)):
            out.append("a name stands twice")
        for e in self.edges.values():
            out += [f"{e.name}: no vertex {v}" for v in (e.subject, e.object) if v not in self.vertices]
        tied = {v for e in self.edges.values() for v in (e.subject, e.object)}
        return out + [f"{v}: no edge touches it" for v in self.vertices if v not in tied]

    def forward(self) -> dict[str, list[tuple[str, str]]]:
        """vertex -> (edge, vertex) that it leads to."""
        out: dict[str, list[tuple[str, str]]] = {v: [] for v in self.vertices}
        for e in self.edges.values():
            out[e.subject].append((e.name, e.object))
            if not e.directed and e.subject != e.object:
                out[e.object].append((e.name, e.subject))
        return {k: sorted(v) for k, v in out.items()}

    def transposed(self) -> dict[str, list[tuple[str, str]]]:
        """vertex -> (edge, vertex) that leads to it."""
        out: dict[str, list[tuple[str, str]]] = {v: [] for v in self.vertices}
        for a, ties in self.forward().items():
            for e, b in ties:
                out[b].append((e, a))
        return {k: sorted(v) for k, v in out.items()}

    def roles(self) -> dict[str, list[str]]:
        """table -> edges by which it plays several roles towards one dimension."""
        by: dict[tuple[str, str], list[str]] = {}
        for e in self.edges.values():
            by.setdefault((e.table, e.object), []).append(e.name)
        out: dict[str, list[str]] = {}
        for (table, _), names in by.items():
            if len(names) > 1 or any(self.edges[n].role for n in names):
                out.setdefault(table, []).extend(sorted(names))
        return out

    def to_mermaid(self) -> str:
        plain = lambda c: re.sub(r"\W", "_", c)
        ties = [f"  {plain(e.subject)} {'-->' if e.directed else '---'}|{e.name}| {plain(e.object)}" for e in self.edges.values()]
        return "\n".join(["graph LR", *(f'  {plain(v)}["{v}"]' for v in self.vertices), *ties])

    def difference(self, new: SchemaGraph) -> dict[str, list[str]]:
        """Names that came, went or changed on the way to another schema."""
        out = {}
        for kind, a, b in (("vertices", self.vertices, new.vertices), ("edges", self.edges, new.edges)):
            out[f"added_{kind}"], out[f"removed_{kind}"] = sorted(set(b) - set(a)), sorted(set(a) - set(b))
            out[f"changed_{kind}"] = sorted(n for n in set(a) & set(b) if a[n] != b[n] or getattr(a[n], "measures", 0) != getattr(b[n], "measures", 0))
        return out

    def check_grains(self, *names: str) -> None:
        """Facts that declare different grains can't be joined as they are."""
        said = {n: self.edges[n].grain for n in names if self.edges[n].grain is not None}
        if len(set(said.values())) > 1:
            raise GrainCompatibilityError("; ".join(f"{n} is by {g}" for n, g in said.items()))


class GraphModel:
    """The graph's data: vertices and edges as frames, and the operators on them by name."""

    def __init__(self, schema: SchemaGraph, tables):
        if bad := schema.validate():
            raise SchemaError("; ".join(bad))
        self.schema = schema
        self._tables = tables if callable(tables) else tables.__getitem__

    def vertex(self, name: str, where: dict | None = None, at: str | None = None) -> DataFrame:
        """Rows of a dimension by values of its columns (None: null), as of a time if it has versions."""
        v = self.schema.vertices[name]
        df = self._tables(v.table)
        if v.versions:
            when = F.lit(at).cast("timestamp_ntz")
            df = df.filter("is_current") if at is None else df.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))
        return df.filter(matching(where or {}))

    def by_key(self, name: str, *key) -> DataFrame:
        """A dimension's rows by natural key."""
        v = self.schema.vertices[name]
        if len(key) != len(v.nk):
            raise SchemaError(f"the key of {name} is {', '.join(v.nk) or 'not declared'}")
        return self.vertex(name, dict(zip(v.nk, key, strict=True)))

    def edges(self, name: str, where: dict | None = None) -> DataFrame:
        """(src, dst, measures) of an edge type; both ways if it isn't directed."""
        e = self.schema.edges[name]
        df = self._tables(e.table).filter(matching(where or {})).select(F.col(e.subject_key).alias("src"), F.col(e.object_key).alias("dst"), *e.measures)
        return df if e.directed else graph.undirected(df)

    def neighbors(self, name: str, starts: DataFrame, direction: str = "out", where: dict | None = None) -> DataFrame:
        return graph.neighbors(self.edges(name, where), starts, direction)

    def paths(self, name: str, starts: DataFrame, max_hops: int, ends: DataFrame | None = None) -> DataFrame:
        return graph.paths(self.edges(name), starts, max_hops, ends)

    def degree(self, name: str, direction: str = "both") -> DataFrame:
        return graph.degree(self.edges(name), direction)

    def aggregate(self, name: str, fn: str, measure: str, direction: str = "out") -> DataFrame:
        """(id, value) over each vertex's edges; a measure that isn't additive can't be summed."""
        additive = self.schema.edges[name].measures.get(measure)
        if additive is None:
            raise SemanticError(f"{name} has no measure {measure}")
        if fn.lower() == "sum" and not additive:
            raise SemanticError(f"{measure} of {name} is not additive")
        return graph.incident(self.edges(name), F.expr(f"{fn}({measure})"), direction)

    def freshness(self, name: str) -> DataFrame | None:
        """One row, fresh: the newest time of an edge type that only grows; None for those whose rows change."""
        e = self.schema.edges[name]
        if e.time is None or e.strategy in ("upsert", "merge"):
            return None
        return self._tables(e.table).agg(F.max(e.time).alias("fresh"))

    def register_view(self, name: str, df: DataFrame) -> str:
        df.createOrReplaceTempView(name)
        return name

    def explain(self, operation: str, *arguments, **options) -> str:
        """The plan of one of the operators above, as text."""
        if operation not in ("vertex", "by_key", "edges", "neighbors", "paths", "degree", "aggregate", "freshness"):
            raise SemanticError(f"no operation {operation!r}")
        df = getattr(self, operation)(*arguments, **options)
        return "" if df is None else df._jdf.queryExecution().toString()


def matching(values: dict) -> Column:
    """All columns have these values; None means null."""
    out = F.lit(True)
    for c, v in values.items():
        out = out & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return out
