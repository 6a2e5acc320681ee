"""Hops between relations and predicates over the paths they make.

A path predicate becomes a semi join (EXISTS), an anti join (FORALL: no row
refutes it), or, under OR and NOT, a left join with a flag on the path's distinct
keys; no correlated subquery is left for the engine to unnest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError
from .expr import Pred, pred, scoped

_EQUAL = re.compile(r"^\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*$")


@dataclass(frozen=True)
class Hop:
    """A join to ``table`` as ``alias`` on ``on``; kind is verb, verb_inverse or bridge, label names it in signatures."""

    table: object
    alias: str
    on: str
    kind: str = "verb"
    label: str = ""


def VerbHop(table, alias: str, on: str, label: str = "") -> Hop:
    return Hop(table, alias, on, "verb", label or alias)


def VerbHopInverse(table, alias: str, on: str, label: str = "") -> Hop:
    return Hop(table, alias, on, "verb_inverse", label or alias)


def BridgeHop(table, alias: str, on: str, label: str = "") -> Hop:
    return Hop(table, alias, on, "bridge", label or alias)


@dataclass(frozen=True)
class Compose:
    left: object
    right: object

    def flatten(self) -> list[Hop]:
        return flatten(self.left) + flatten(self.right)


def flatten(path) -> list[Hop]:
    if isinstance(path, Hop):
        return [path]
    if isinstance(path, Compose):
        return path.flatten()
    return [h for p in path for h in flatten(p)]


def aliased(df: DataFrame, alias: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{alias}__{c}") for c in df.columns])


def split_on(on: str, inner: set[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Equalities (outer column, inner column) and other conditions of a hop's ON."""
    keys, rest = [], []
    for part in re.split(r"\s+AND\s+", on, flags=re.I):
        m = _EQUAL.match(part)
        if m and (m[1] in inner) != (m[3] in inner):
            a, b = f"{m[1]}__{m[2]}", f"{m[3]}__{m[4]}"
            keys.append((b, a) if m[1] in inner else (a, b))
        else:
            rest.append(part)
    return keys, rest


@dataclass(eq=False)
class PathPred(Pred):
    """EXISTS (or FORALL) over the rows that a chain of hops reaches from the outer row.

    The first hop's ON ties the chain to the outer row by equalities; later hops are
    inner joins inside; ``where`` is the condition on reached rows.
    """

    path: object
    where: Pred | str | None = None
    quantifier: str = "EXISTS"
    _flag: str = field(default="", init=False)

    def text(self) -> str:
        hops = "; ".join(f"{h.kind} {h.alias} ON {h.on}" for h in flatten(self.path))
        return f"{self.quantifier}[{hops}]({pred(self.where).text() if self.where is not None else 'TRUE'})"

    def inner(self, env) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Reached rows (for FORALL: those that refute it) and the key pairs (outer, inner)."""
        hops = flatten(self.path)
        df = aliased(env(hops[0].table), hops[0].alias)
        keys, rest = split_on(hops[0].on, {hops[0].alias})
        if not keys or rest and any(r for r in rest if {m for m in re.findall(r"(\w+)\.", r)} - {hops[0].alias}):
            raise SemanticError("a path is tied to its outer row by equalities")
        for r in rest:
            df = df.filter(scoped(r))
        for h in hops[1:]:
            df = df.join(aliased(env(h.table), h.alias), F.expr(scoped(h.on)), "inner")
        if self.where is not None:
            w = pred(self.where).column()
            df = df.filter(~F.coalesce(w, F.lit(False)) if self.quantifier == "FORALL" else w)
        elif self.quantifier == "FORALL":
            df = df.limit(0)
        return df, keys

    def semi(self, outer: DataFrame, env, negate: bool = False) -> DataFrame:
        """Filter the outer rows directly: the way for conjunctive use."""
        df, keys = self.inner(env)
        cond = [F.col(o) == F.col(i) for o, i in keys]
        anti = negate != (self.quantifier == "FORALL")
        return outer.join(df.select([F.col(i) for _, i in keys]), cond, "left_anti" if anti else "left_semi")

    def flagged(self, outer: DataFrame, env, name: str) -> DataFrame:
        """Add a boolean column: the way under OR and NOT."""
        df, keys = self.inner(env)
        self._flag = name
        marks = df.select([F.col(i) for _, i in keys]).distinct().select([F.col(i).alias(f"{name}_{i}") for _, i in keys] + [F.lit(True).alias(f"{name}_hit")])
        out = outer.join(marks, [F.col(o) == F.col(f"{name}_{i}") for o, i in keys], "left")
        hit = F.coalesce(F.col(f"{name}_hit"), F.lit(False))
        return out.withColumn(name, ~hit if self.quantifier == "FORALL" else hit).drop(f"{name}_hit", *(f"{name}_{i}" for _, i in keys))

    def column(self) -> Column:
        return F.col(self._flag)


def path_preds(p: Pred) -> list[PathPred]:
    if isinstance(p, PathPred):
        return [p]
    return [x for c in p.children() for x in path_preds(c)]


@dataclass(frozen=True)
class PathAgg:
    """An aggregate over the rows a path reaches: grouped by the tie to the outer row, then joined to it."""

    path: object
    agg: str
    name: str
    where: Pred | str | None = None
    default: object = None

    def joined(self, outer: DataFrame, env) -> DataFrame:
        df, keys = PathPred(self.path, self.where).inner(env)
        sums = df.groupBy([F.col(i) for _, i in keys]).agg(F.expr(scoped(self.agg)).alias(self.name))
        out = outer.join(sums, [F.col(o) == F.col(i) for o, i in keys], "left").drop(*(i for _, i in keys))
        return out if self.default is None else out.withColumn(self.name, F.coalesce(F.col(self.name), F.lit(self.default)))
