"""Where columns come from: as declared, by references, and as Catalyst resolves a frame; and a log of what ran."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..storage import publish


@dataclass(frozen=True)
class Edge:
    """``target`` is made of ``source`` (both table.column); kind is declared, reference or plan."""

    source: str
    target: str
    kind: str
    how: str = ""


def declared(table: str, columns: dict[str, list[str]], how: str = "") -> list[Edge]:
    """Target columns of a table with the source columns they are said to come from."""
    return [Edge(s, f"{table}.{c}", "declared", how) for c, sources in columns.items() for s in sources]


def by_reference(entities) -> list[Edge]:
    """Edges from the dimensions' keys to the columns of entities (``operators.warehouse``) that refer to them."""
    return [Edge(f"{r.dimension}.{r.sk}", f"{e.name}.{r.name or r.column + '_sk'}", "reference", r.column) for e in entities for r in e.references]


_ID = re.compile(r"([`\w.]+)#(\d+)L?")


def of_plan(df: DataFrame, target: str) -> list[Edge]:
    """Which columns of its sources each column of a frame is made of, from the optimised plan.

    Every attribute of the plan has a number.  Scans name the numbers of their columns,
    and an alias makes a new number of those in its expression; what a union joins by
    place is followed by place.
    """
    plan = df._jdf.queryExecution().analyzed()
    made: dict[str, set[str]] = {}
    leaves: dict[str, str] = {}

    def seq(s):
        return [s.apply(i) for i in range(s.size())]

    def key(a) -> str:
        return str(a.exprId().id())

    def walk(p):
        kind = p.getClass().getSimpleName()
        children = seq(p.children())
        for c in children:
            walk(c)
        if not children:
            found = re.search(r"(?:parquet|csv|json|orc|text|SubqueryAlias) ?([\w.]*)", p.toString())
            name = source_name(p) or (found[1] if found and found[1] else kind.lower())
            for a in seq(p.output()):
                leaves.setdefault(key(a), f"{name}.{a.name()}")
            return
        if kind == "Union":
            for c in children:
                for a, b in zip(seq(p.output()), seq(c.output()), strict=True):
                    if key(a) != key(b):
                        made.setdefault(key(a), set()).add(key(b))
        for e in seq(p.expressions()):
            note(e)

    def note(e):
        if e.getClass().getSimpleName() == "Alias":
            made.setdefault(key(e), set()).update(key(a) for a in seq(e.references().toSeq()))
        for c in seq(e.children()):
            note(c)

    walk(plan)

    def sources(k: str, seen: frozenset = frozenset()) -> set[str]:
        if k in seen:
            return set()
        own = {leaves[k]} if k in leaves else set()  # a union's columns have the numbers of its first part's
        return own.union(*(sources(x, seen | {k}) for x in made.get(k, ())))

    return sorted({Edge(s, f"{target}.{a.name()}", "plan") for a in seq(plan.output()) for s in sources(key(a))}, key=lambda e: (e.target, e.source))


def source_name(leaf) -> str | None:
    """The last part of the path that a file relation reads, without its ending."""
    try:
        paths = leaf.relation().location().rootPaths()
        return re.sub(r"\.\w+$", "", paths.apply(0).getName())
    except Exception:  # not a relation of files
        return None


class Graph:
    """Edges put together; what a column comes from and what comes from it."""

    def __init__(self, edges: list[Edge] | None = None):
        self.edges: list[Edge] = []
        self.add(edges or [])

    def add(self, edges: list[Edge]) -> Graph:
        self.edges += [e for e in edges if e not in self.edges]
        return self

    def _reach(self, column: str, up: bool) -> set[str]:
        seen, todo = set(), [column]
        while todo:
            x = todo.pop()
            for e in self.edges:
                a, b = (e.target, e.source) if up else (e.source, e.target)
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    def upstream(self, column: str) -> set[str]:
        return self._reach(column, True)

    def downstream(self, column: str) -> set[str]:
        return self._reach(column, False)

    def to_mermaid(self) -> str:
        plain = lambda c: re.sub(r"\W", "_", c)
        return "\n".join(["graph LR", *(f'  {plain(e.source)}["{e.source}"] --> {plain(e.target)}["{e.target}"]' for e in self.edges)])


@dataclass
class Event:
    """Something that ran: started, finished, failed, inferred, passed."""

    kind: str
    job: str
    details: dict = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    time: float = field(default_factory=time.time)


class Emitter:
    """Gives events to all its sinks; one that fails doesn't keep the others from them."""

    def __init__(self, *sinks: Callable[[Event], None]):
        self.sinks, self.errors = list(sinks), []

    def emit(self, event: Event) -> Event:
        for s in self.sinks:
            try:
                s(event)
            except Exception as e:
                self.errors.append(f"{event.kind} {event.job}: {e}")
        return event

    def named(self, job: str) -> Callable[[str, dict], None]:
        """A function (kind, details) for the operators that report."""
        return lambda kind, details: self.emit(Event(kind, job, details)) and None


def into_folder(spark, folder: str) -> Callable[[Event], None]:
    """A sink: a JSON file an event, in a folder of any file system; ``spark.read.json`` reads them."""
    return lambda e: publish(spark, f"{folder.rstrip('/')}/{int(e.time * 1e6)}-{e.run}-{e.kind}.json", json.dumps(asdict(e))) and None
