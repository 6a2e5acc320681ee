"""Named questions and their composition.

A question is a DataFrame, so composing builds one lazy plan; what several answers
share is the same frame, which Catalyst reads once within a plan (reused exchanges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError


class QuestionAlgebra:
    def __init__(self):
        self._questions: dict[str, DataFrame] = {}
        self._sql: dict[str, tuple[str, tuple[str, ...]]] = {}

    def add(self, name: str, question: DataFrame, sql: str | None = None) -> QuestionAlgebra:
        """A question; with its SQL, compositions of it have SQL too."""
        if name in self._questions:
            raise SemanticError(f"there is a question {name} already")
        self._questions[name] = question
        if sql is not None:
            self._sql[name] = (sql, ())
        return self

    def to_sql(self, final: str) -> str:
        """The question's rows by a chain of WITH parts, in the order in which they were added."""
        needed, todo = set(), [final]
        while todo:
            n = todo.pop()
            if n not in self._sql:
                raise SemanticError(f"{n} has no SQL")
            if n not in needed:
                needed.add(n)
                todo += self._sql[n][1]
        return f"WITH {', '.join(f'{n} AS ({self._sql[n][0]})' for n in self._questions if n in needed)} SELECT * FROM {final}"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._questions:
            raise SemanticError(f"no question {name}")
        return self._questions[name]

    def compose(self, left: str, op: str, right: str, name: str, on: str | None = None) -> QuestionAlgebra:
        """UNION keeps repeated rows, INTERSECT and EXCEPT are distinct, WITH is the right side, JOIN is inner on a condition over l and r."""
        a, b, op = self[left], self[right], op.upper()
        if op == "JOIN":
            if not on:
                raise SemanticError("a JOIN needs a condition")
            taken = {c.lower() for c in a.columns}
            more = [F.col(f"r.`{c}`").alias(f"r_{c}" if c.lower() in taken else c) for c in b.columns]
            out = a.alias("l").join(b.alias("r"), F.expr(on)).select("l.*", *more)
        elif op in ("UNION", "INTERSECT", "EXCEPT", "WITH"):
            if op != "WITH" and len(a.columns) != len(b.columns):
                raise SemanticError(f"{op} of {len(a.columns)} and {len(b.columns)} columns")
            out = {"UNION": a.union, "INTERSECT": a.intersect, "EXCEPT": a.subtract, "WITH": lambda _: b}[op](b)
        else:
            raise SemanticError(f"unknown operation {op}")
        self.add(name, out)
        if left in self._sql and right in self._sql:
            if op == "JOIN":
                text = f"SELECT l.*, {', '.join(f'r.{c} AS r_{c}' if c.lower() in taken else f'r.{c}' for c in b.columns)} FROM {left} l JOIN {right} r ON {on}"
            elif op == "WITH":
                text = f"SELECT * FROM {right}"
            else:
                text = f"SELECT * FROM {left} {'UNION ALL' if op == 'UNION' else op} SELECT * FROM {right}"
            self._sql[name] = (text, (right,) if op == "WITH" else (left, right))
        return self

    def top(self, *names: str) -> DataFrame:
        """The identity of INTERSECT among some questions: every row that one of them has."""
        out = self[names[0]]
        for n in names[1:]:
            out = out.union(self[n])
        return out.distinct()

    def empty(self, like: str) -> DataFrame:
        """The identity of UNION: no rows."""
        return self[like].limit(0)

    def suggestions(self, keys: dict[str, str]) -> list[tuple[str, str]]:
        """Pairs of questions that share an anchor, given each question's anchor."""
        names = sorted(n for n in keys if n in self._questions)
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if keys[a] == keys[b]]
