"""Three-band query builder: context and filters, aggregation, window ranking.

``to_df`` declares the plan: joins -> filter -> group and having -> window and qualify
-> projection.  Join strategies, pushdown and pruning are Catalyst's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GrainCompatibilityError, SemanticError
from .expr import AggRef, And, Not, Or, Pred, PropRef, WinRef, dotted, pred, refs, scoped
from .paths import Hop, PathAgg, PathPred, aliased, flatten, path_preds
from .temporal import TimeWindow


@dataclass(frozen=True)
class SemiAdditive:
    """How a measure that must not be summed over some columns is taken: last, avg or max."""

    measure: str
    forbidden: tuple[str, ...]
    fallback: str = "last"
    order: str | None = None

    def sql(self, group: list[str]) -> str:
        # without a group a sum would run over the forbidden columns too
        if set(group) & set(self.forbidden) or not group:
            if self.fallback == "last":
                if not self.order:
                    raise SemanticError("'last' needs an order")
                return f"max_by({self.measure}, {self.order})"
            return f"{self.fallback}({self.measure})"
        return f"sum({self.measure})"


class Query:
    """Build with chained calls, then ``to_df(spark, tables)``; ``tables`` maps names to DataFrames or is a function."""

    def __init__(self):
        self._anchor = self._alias = None
        self._joins: list[tuple[object, str, str, str, bool]] = []
        self._where: Pred | None = None
        self._having: Pred | None = None
        self._qualify: Pred | None = None
        self._group: list[tuple[str, str]] = []
        self._aggs: dict[str, str] = {}
        self._semi: list[tuple[str, SemiAdditive]] = []
        self._windows: dict[str, str] = {}
        self._columns: dict[str, str] = {}
        self._path_aggs: list[PathAgg] = []
        self._as_of: tuple[str, str, str] | None = None
        self._strict = False
        self._order: list[str] = []
        self._limit: int | None = None
        self._distinct = False
        self._fks: dict[tuple[str, str], list[tuple[str, str]]] = {}
        self._additive: dict[str, bool] = {}
        self._trims: list[tuple[str, str, DataFrame]] = []

    # band 1
    def anchor(self, table, alias: str) -> Query:
        self._anchor, self._alias = table, alias
        return self

    def path_join(self, *path, how: str = "left") -> Query:
        """Join hops from the rows so far (left outer unless told otherwise)."""
        for h in flatten(path):
            self._joins.append((h.table, h.alias, h.on, how, h.kind != "bridge"))
        return self

    def foreign_keys(self, keys: dict[tuple[str, str], list[tuple[str, str]]]) -> Query:
        """(from table, to table) -> candidate (fk column, pk column) pairs, for ``join_model``."""
        self._fks = keys
        return self

    def join_model(self, from_table: str, to_table: str, from_alias: str, to_alias: str, how: str = "left") -> Query:
        """Join by the only foreign key between two tables."""
        found = self._fks.get((from_table, to_table), [])
        if len(found) != 1:
            raise SemanticError(f"{len(found)} foreign keys from {from_table} to {to_table}; one is needed")
        fk, pk = found[0]
        return self.path_join(Hop(to_table, to_alias, f"{to_alias}.{pk} = {from_alias}.{fk}"), how=how)

    def join_dim(self, dim, fk: str, pk: str, alias: str | None = None, at: str | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Query:
        """SCD2 dimension: the current row, or with ``at`` (a column of a relation joined before) the row valid then."""
        a = alias or f"d_{dim}"
        tie = f"{a}.is_current" if at is None else f"{a}.{valid_from} <= {at} AND ({a}.{valid_to} IS NULL OR {a}.{valid_to} > {at})"
        self._joins.append((dim, a, f"{a}.{pk} = {fk} AND {tie}", "left", False))
        return self

    def as_of(self, ts: str, valid_from: str = "valid_from", valid_to: str = "valid_to", strict: bool = False) -> Query:
        """All verb joins see the version valid at ``ts`` (an SQL expression); strict drops rows without one."""
        self._as_of, self._strict = (ts, valid_from, valid_to), strict
        return self

    def measures(self, additive: dict[str, bool]) -> Query:
        """Which measures (alias.column) may be summed; a sum of one that may not is refused."""
        self._additive |= additive
        return self

    def facts(self, grains: dict[str, str | None]) -> Query:
        """Declared grains of the facts that are joined (None: no claim); different ones are refused."""
        known = {t: g for t, g in grains.items() if g is not None}
        if len(set(known.values())) > 1:
            raise GrainCompatibilityError("facts of different grains: " + ", ".join(f"{t} ({g})" for t, g in sorted(known.items())))
        return self

    def trim(self, src: str, dst: str, edges: DataFrame) -> Query:
        """Keep rows whose (src, dst) columns are among edges (src, dst), such as ``graph.trim_*`` leave."""
        self._trims.append((src, dst, edges))
        return self

    def cross_join(self, table, alias: str) -> Query:
        """Every row with every row of a small relation."""
        self._joins.append((table, alias, "", "cross", False))
        return self

    def where(self, p: Pred | str) -> Query:
        p = pred(p)
        if any(isinstance(r, (AggRef, WinRef)) for r in refs(p)):
            raise SemanticError("WHERE takes properties only")
        self._where = p if self._where is None else And(self._where, p)
        return self

    def path_agg(self, agg: PathAgg) -> Query:
        self._path_aggs.append(agg)
        return self

    def column(self, **exprs: str) -> Query:
        """Named expressions over the joined rows."""
        self._columns |= exprs
        return self

    # band 2
    def group_by(self, *cols: str) -> Query:
        for c in cols:
            self._group.append((c, c.rpartition(".")[2]))
        return self

    def date_trunc_by(self, col: str, grain: str, alias: str) -> Query:
        self._group.append((f"cast(date_trunc('{grain}', {col}) as timestamp_ntz)", alias))
        return self

    def agg(self, **exprs: str) -> Query:
        self._aggs |= exprs
        return self

    def sum(self, col: str) -> Query:
        return self.agg(**{f"sum_{col.rpartition('.')[2]}": f"sum({col})"})

    def avg(self, col: str) -> Query:
        return self.agg(**{f"avg_{col.rpartition('.')[2]}": f"avg({col})"})

    def count(self) -> Query:
        return self.agg(count="count(*)")

    def semi_additive(self, name: str, rule: SemiAdditive) -> Query:
        self._semi.append((name, rule))
        return self

    def aggregate(self, by: list[str], having: Pred | str | None = None, **exprs: str) -> Query:
        """Band 2 in one call."""
        self.group_by(*by).agg(**exprs)
        return self if having is None else self.having(having)

    def having(self, p: Pred | str) -> Query:
        p = pred(p)
        if path_preds(p) or any(isinstance(r, (PropRef, WinRef)) for r in refs(p)):
            raise SemanticError("HAVING takes aggregates only")
        self._having = p if self._having is None else And(self._having, p)
        return self

    # band 3
    def window(self, **exprs: str) -> Query:
        self._windows |= exprs
        return self

    def rank(self, name: str, partition: str, order: str, top: int) -> Query:
        over = f"(PARTITION BY {partition} ORDER BY {order})" if partition else f"(ORDER BY {order})"
        return self.window(**{name: f"rank() OVER {over}"}).qualify(WinRef(name) <= top)

    def temporal_agg(self, name: str, fn: str, measure: str, ts: str, window: TimeWindow, partition: tuple[str, ...] = ()) -> Query:
        """An aggregate over the rows that a time window gives each row."""
        return self.window(**{name: window.sql(fn, measure, ts, list(partition))})

    def ntile_bucket(self, measure: str, n: int, alias: str) -> Query:
        return self.window(**{alias: f"ntile({n}) OVER (ORDER BY {measure})"})

    def width_bucket(self, measure: str, bounds: list[float], alias: str) -> Query:
        """The number of bounds at or below the measure."""
        edges = ", ".join(f"double({b})" for b in bounds)
        return self.window(**{alias: f"cast(size(filter(array({edges}), b -> b <= {measure})) as bigint)"})

    def qualify(self, p: Pred | str) -> Query:
        p = pred(p)
        if path_preds(p) or any(isinstance(r, (PropRef, AggRef)) for r in refs(p)):
            raise SemanticError("QUALIFY takes window names only")
        self._qualify = p if self._qualify is None else And(self._qualify, p)
        return self

    # output
    def order_by(self, *cols: str) -> Query:
        self._order += cols
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def distinct(self) -> Query:
        self._distinct = True
        return self

    def validate(self) -> None:
        if self._anchor is None:
            raise SemanticError("a query needs an anchor")
        if self._having is not None and not (self._aggs or self._semi):
            raise SemanticError("HAVING needs an aggregate")
        if self._qualify is not None and not self._windows:
            raise SemanticError("QUALIFY needs a window")
        for m, additive in self._additive.items():
            if not additive and any(re.search(rf"\bsum\s*\(\s*(distinct\s+)?{re.escape(m)}\s*\)", e, re.I) for e in self._aggs.values()):
                raise SemanticError(f"{m} is not additive; take its average, least or greatest value")

    def signature(self) -> tuple:
        """What two queries must share for their conditions alone to tell them apart."""
        return (str(self._anchor), self._alias, tuple((str(t), a, on, how) for t, a, on, how, _ in self._joins), tuple(self._columns.items()), tuple(self._group), tuple(self._aggs.items()), tuple(self._windows.items()))

    def joined(self, env) -> DataFrame:
        df = aliased(env(self._anchor), self._alias)
        for table, alias, on, how, verb in self._joins:
            right = aliased(env(table), alias)
            if how == "cross":
                df = df.crossJoin(right)  # broadcast where its size is under Spark's threshold
                continue
            if self._as_of and verb:
                ts, since, until = self._as_of
                if f"{alias}__{since}" in right.columns:
                    on = f"{on} AND {alias}.{since} <= {ts} AND ({alias}.{until} IS NULL OR {alias}.{until} > {ts})"
                    how = "inner" if self._strict else how
            df = df.join(right, F.expr(scoped(on)), how)
        return df

    def _filtered(self, df: DataFrame, env) -> DataFrame:
        flags = 0
        for p in conjuncts(self._where) if self._where is not None else []:
            bare = p.arg if isinstance(p, Not) else p
            if isinstance(bare, PathPred):
                df = bare.semi(df, env, isinstance(p, Not))
                continue
            extra = []
            for q in path_preds(p):
                flags += 1
                extra.append(f"_path{flags}")
                df = q.flagged(df, env, extra[-1])
            df = df.filter(p.column()).drop(*extra)
        return df

    def to_df(self, spark: SparkSession, tables) -> DataFrame:
        self.validate()

        def env(t):
            return t if isinstance(t, DataFrame) else tables(t) if callable(tables) else tables[t]

        df = self._filtered(self.joined(env), env)
        for src, dst, edges in self._trims:
            kept = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).distinct()
            df = df.join(kept, [F.expr(scoped(src)) == F.col("_src"), F.expr(scoped(dst)) == F.col("_dst")], "left_semi")
        for p in self._path_aggs:
            df = p.joined(df, env)
        if self._columns:
            df = df.select("*", *(F.expr(scoped(e)).alias(n) for n, e in self._columns.items()))
        if self._group or self._aggs or self._semi:
            group = [c for c, _ in self._group]
            aggs = self._aggs | {n: r.sql(group) for n, r in self._semi}
            keys = [F.expr(scoped(c)).alias(n) for c, n in self._group]
            names = [n for _, n in self._group]
            df = df.groupBy(keys).agg(*(F.expr(scoped(e)).alias(n) for n, e in aggs.items())) if aggs else df.select(keys).distinct()
            # band 3 sees groups and aggregates by name; an aggregate repeated there means its column
            again = {scoped(e).lower(): n for n, e in aggs.items()} | {scoped(c).lower(): n for c, n in self._group}
            if self._having is not None:
                df = df.filter(self._having.column())
            named = lambda e: _by_name(scoped(e), again)
            out = [*names, *aggs]
        else:
            named = scoped
            out = None
        if self._windows:
            df = df.select("*", *(F.expr(named(e)).alias(n) for n, e in self._windows.items()))
        if self._qualify is not None:
            df = df.filter(self._qualify.column())
        df = df.select(*out, *self._windows) if out is not None else self._projected(df)
        df = df.distinct() if self._distinct else df
        if self._order:
            df = df.orderBy(*(F.expr(o.rsplit(" ", 1)[0]).desc() if o.lower().endswith(" desc") else F.expr(o).asc() for o in self._order))
        return df.limit(self._limit) if self._limit is not None else df

    def to_sql(self) -> str:
        """The query as SQL over tables of the anchor's and hops' names (which must be names then)."""
        self.validate()
        joins = "".join(f" CROSS JOIN {t} {a}" if how == "cross" else f" {how.upper()} JOIN {t} {a} ON {on}" for t, a, on, how, _ in self._joins)
        names = [self._anchor, *(t for t, *_ in self._joins)]
        if not all(isinstance(t, str) for t in names):
            raise SemanticError("a frame without a name has no SQL")
        where = f" WHERE {condition_sql(self._where)}" if self._where is not None else ""
        if self._path_aggs or self._as_of or self._trims:
            raise SemanticError("path aggregates, as-of joins and trims run as frames only")
        body = f"FROM {self._anchor} {self._alias}{joins}{where}"
        extra = "".join(f", {e} AS {n}" for n, e in self._columns.items())
        if self._group or self._aggs or self._semi:
            group = [c for c, _ in self._group]
            aggs = self._aggs | {n: r.sql(group) for n, r in self._semi}
            shown = ", ".join([*(f"{c} AS {n}" for c, n in self._group), *(f"{e} AS {n}" for n, e in aggs.items())])
            sql = f"SELECT {shown} {body}" + (f" GROUP BY {', '.join(group)}" if group else "")
            if self._having is not None:
                sql = f"SELECT * FROM ({sql}) AS g WHERE {condition_sql(self._having)}"
            again = {e.lower(): n for n, e in aggs.items()} | {c.lower(): n for c, n in self._group}
            if self._windows:
                sql = f"SELECT *, {', '.join(f'{_by_name(e, again)} AS {n}' for n, e in self._windows.items())} FROM ({sql}) AS a"
        else:
            sql = f"SELECT *{extra}" + "".join(f", {e} AS {n}" for n, e in self._windows.items()) + f" {body}"
        if self._qualify is not None:
            sql = f"SELECT * FROM ({sql}) AS w WHERE {condition_sql(self._qualify)}"
        sql = sql.replace("SELECT", "SELECT DISTINCT", 1) if self._distinct else sql
        if self._order:
            sql += f" ORDER BY {', '.join(self._order)}"
        return sql if self._limit is None else f"{sql} LIMIT {self._limit}"

    def _projected(self, df: DataFrame) -> DataFrame:
        """Own names where they are unique, alias_name where not."""
        bare = [c.partition("__")[2] or c for c in df.columns]
        return df.select([F.col(c).alias(b if bare.count(b) == 1 else c.replace("__", "_", 1)) for c, b in zip(df.columns, bare, strict=True)])


def _by_name(sql: str, names: dict[str, str]) -> str:
    """The SQL with each expression that is one of ``names``, as whole tokens, replaced by its name."""
    token = re.compile(r"'(?:[^']|'')*'|\w+|\S")
    known = sorted(((token.findall(e), n) for e, n in names.items()), key=lambda x: -len(x[0]))
    found = token.findall(sql)
    low, out, at = [t if t[0] == "'" else t.lower() for t in found], [], 0
    while at < len(found):
        hit = next(((e, n) for e, n in known if e and low[at : at + len(e)] == e and not (at and low[at - 1] == ".")), None)
        out.append(hit[1] if hit else found[at])
        at += len(hit[0]) if hit else 1
    return re.sub(r"\s*([.,()])\s*", lambda m: m[1] + (" " if m[1] in ",)" else ""), " ".join(out)).replace("( ", "(")


def condition_sql(p: Pred) -> str:
    """A predicate as SQL; paths become EXISTS and NOT EXISTS."""
    if isinstance(p, And | Or):
        return "(" + f" {p.word} ".join(condition_sql(a) for a in p.args) + ")"
    if isinstance(p, Not):
        return f"NOT ({condition_sql(p.arg)})"
    if not isinstance(p, PathPred):
        return p.text()
    first, *rest = flatten(p.path)
    inner = f"SELECT 1 FROM {first.table} {first.alias}" + "".join(f" JOIN {h.table} {h.alias} ON {h.on}" for h in rest) + f" WHERE {first.on}"
    told = None if p.where is None else condition_sql(pred(p.where))
    if p.quantifier == "FORALL":
        return "TRUE" if told is None else f"NOT EXISTS ({inner} AND NOT COALESCE({told}, FALSE))"
    return f"EXISTS ({inner}{'' if told is None else f' AND {told}'})"


def conjuncts(p: Pred) -> list[Pred]:
    return [x for a in p.args for x in conjuncts(a)] if isinstance(p, And) else [p]


def aliases_of(p: Pred) -> set[str]:
    return dotted(p.text())


__all__ = ["Query", "SemiAdditive", "conjuncts", "aliases_of", "Or"]
