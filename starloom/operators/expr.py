"""References and predicates of the query builder, lowered to Columns.

A column of alias ``a`` is called ``a__col`` inside a plan, so joins never clash;
``scoped`` rewrites ``a.col`` in free SQL text accordingly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError

_DOTTED = re.compile(r"'(?:[^']|'')*'|\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)")


def scoped(sql: str) -> str:
    """``a.col`` -> ``a__col`` outside string literals."""
    return _DOTTED.sub(lambda m: f"{m[1]}__{m[2]}" if m[1] else m[0], sql)


def dotted(sql: str) -> set[str]:
    """Aliases that a piece of SQL mentions."""
    return {m[1] for m in _DOTTED.finditer(sql) if m[1]}


class Pred:
    """A condition; ``&``, ``|`` and ``~`` compose."""

    def __and__(self, other: Pred) -> Pred:
        return And(self, other)

    def __or__(self, other: Pred) -> Pred:
        return Or(self, other)

    def __invert__(self) -> Pred:
        return self.arg if isinstance(self, Not) else Not(self)

    def column(self) -> Column:
        raise NotImplementedError

    def text(self) -> str:
        """Canonical SQL: equal text means an equal condition."""
        raise NotImplementedError

    def children(self) -> tuple[Pred, ...]:
        return ()


class Value:
    """Something with a value in a row; comparisons make predicates."""

    def sql(self) -> str:
        raise NotImplementedError

    def column(self) -> Column:
        return F.expr(scoped(self.sql()))

    def _cmp(self, op: str, other) -> ScalarPred:
        return ScalarPred(self, op, other)

    def __eq__(self, other):  # type: ignore[override]
        return self._cmp("=", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._cmp("<>", other)

    def __lt__(self, other):
        return self._cmp("<", other)

    def __le__(self, other):
        return self._cmp("<=", other)

    def __gt__(self, other):
        return self._cmp(">", other)

    def __ge__(self, other):
        return self._cmp(">=", other)

    __hash__ = object.__hash__

    def isin(self, values) -> ScalarPred:
        return self._cmp("IN", tuple(values))

    def like(self, pattern: str) -> ScalarPred:
        return self._cmp("LIKE", pattern)

    def is_null(self) -> ScalarPred:
        return self._cmp("IS NULL", None)

    def is_not_null(self) -> ScalarPred:
        return self._cmp("IS NOT NULL", None)

    def __add__(self, other):
        return Arith(self, "+", other)

    def __sub__(self, other):
        return Arith(self, "-", other)

    def __mul__(self, other):
        return Arith(self, "*", other)

    def __truediv__(self, other):
        return Arith(self, "/", other)


@dataclass(frozen=True, eq=False)
class PropRef(Value):
    """A property of a joined relation: PropRef("c.name") or PropRef("c", "name")."""

    alias: str
    prop: str = ""

    def sql(self) -> str:
        return f"{self.alias}.{self.prop}" if self.prop else self.alias


@dataclass(frozen=True, eq=False)
class AggRef(Value):
    """The name of an aggregate; allowed in HAVING only."""

    name: str

    def sql(self) -> str:
        return self.name


@dataclass(frozen=True, eq=False)
class WinRef(Value):
    """The name of a window expression; allowed in QUALIFY only."""

    name: str

    def sql(self) -> str:
        return self.name


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True, eq=False)
class Const(Value):
    value: object

    def sql(self) -> str:
        return literal(self.value)

    def column(self) -> Column:
        return F.lit(self.value)


def as_value(x) -> Value:
    return x if isinstance(x, Value) else Const(x)


@dataclass(frozen=True, eq=False)
class Arith(Value):
    left: object
    op: str
    right: object

    def sql(self) -> str:
        return f"({as_value(self.left).sql()} {self.op} {as_value(self.right).sql()})"

    def column(self) -> Column:
        a, b = as_value(self.left).column(), as_value(self.right).column()
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[self.op]


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True, eq=False)
class ScalarPred(Pred):
    """ref op value; op may also be IN, LIKE, IS NULL, IS NOT NULL."""

    ref: Value
    op: str
    value: object = None

    def column(self) -> Column:
        a, op = self.ref.column(), self.op.upper()
        if op == "IS NULL":
            return a.isNull()
        if op == "IS NOT NULL":
            return a.isNotNull()
        if op == "IN":
            return a.isin(list(self.value))
        if op == "NOT IN":
            return ~a.isin(list(self.value))
        if op == "LIKE":
            return a.like(self.value)
        if op not in _OPS:
            raise SemanticError(f"unknown operator {self.op}")
        return _OPS[op](a, as_value(self.value).column())

    def text(self) -> str:
        if self.op.upper() in ("IS NULL", "IS NOT NULL"):
            return f"{self.ref.sql()} {self.op.upper()}"
        if self.op.upper() in ("IN", "NOT IN"):
            return f"{self.ref.sql()} {self.op.upper()} ({', '.join(sorted(literal(v) for v in self.value))})"
        return f"{self.ref.sql()} {self.op.upper()} {as_value(self.value).sql()}"


class _Many(Pred):
    word = ""

    def __init__(self, *args: Pred):
        self.args = args

    def children(self):
        return self.args

    def text(self) -> str:
        return "(" + f" {self.word} ".join(a.text() for a in self.args) + ")"


class And(_Many):
    word = "AND"

    def column(self) -> Column:
        out = self.args[0].column()
        for a in self.args[1:]:
            out = out & a.column()
        return out


class Or(_Many):
    word = "OR"

    def column(self) -> Column:
        out = self.args[0].column()
        for a in self.args[1:]:
            out = out | a.column()
        return out


class Not(Pred):
    def __init__(self, arg: Pred):
        self.arg = arg

    def children(self):
        return (self.arg,)

    def column(self) -> Column:
        return ~self.arg.column()

    def text(self) -> str:
        return f"NOT {self.arg.text()}"


@dataclass(frozen=True, eq=False)
class Raw(Pred):
    sql: str

    def column(self) -> Column:
        return F.expr(scoped(self.sql))

    def text(self) -> str:
        return f"({self.sql})"


def refs(p: Pred) -> list[Value]:
    """All references in a predicate."""
    if isinstance(p, ScalarPred):
        return [x for x in (p.ref, p.value) if isinstance(x, Value)]
    return [r for c in p.children() for r in refs(c)]


def pred(p: Pred | str) -> Pred:
    return Raw(p) if isinstance(p, str) else p
