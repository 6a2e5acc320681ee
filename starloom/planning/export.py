"""A query's declaration in other notations."""

from __future__ import annotations

import json
import re

from ..errors import SemanticError
from ..operators.expr import PropRef, ScalarPred
from ..operators.query import Query, condition_sql, conjuncts

_EQUAL = re.compile(r"^\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*$")


def as_dict(q: Query) -> dict:
    """The bands as plain values."""
    out = {
        "anchor": {"table": str(q._anchor), "alias": q._alias},
        "joins": [{"table": str(t), "alias": a, "on": on, "how": how} for t, a, on, how, _ in q._joins],
        "where": None if q._where is None else condition_sql(q._where),
        "group_by": [{"expression": c, "name": n} for c, n in q._group],
        "aggregates": dict(q._aggs),
        "having": None if q._having is None else condition_sql(q._having),
        "windows": dict(q._windows),
        "qualify": None if q._qualify is None else condition_sql(q._qualify),
        "order_by": list(q._order),
        "limit": q._limit,
    }
    return {k: v for k, v in out.items() if v not in (None, [], {})}


def as_json(q: Query) -> str:
    return json.dumps(as_dict(q), indent=2)


def as_yaml(q: Query) -> str:
    """YAML of the same; strings stand quoted as in JSON."""

    def lines(v, deep: int):
        pad = "  " * deep
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, dict | list):
                    yield f"{pad}{k}:"
                    yield from lines(x, deep + 1)
                else:
                    yield f"{pad}{k}: {json.dumps(x)}"
        else:
            for x in v:
                if isinstance(x, dict):
                    inner = list(lines(x, deep + 1))
                    yield f"{pad}- {inner[0].strip()}"
                    yield from inner[1:]
                else:
                    yield f"{pad}- {json.dumps(x)}"

    return "\n".join(lines(as_dict(q), 0)) + "\n"


def _name(x: str) -> str:
    return "".join(w.capitalize() for w in re.split(r"[_\W]+", x) if w)


def _value(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scalars(q: Query) -> list[ScalarPred]:
    parts = conjuncts(q._where) if q._where is not None else []
    bad = [p for p in parts if not (isinstance(p, ScalarPred) and isinstance(p.ref, PropRef))]
    if bad:
        raise SemanticError(f"graph notations take comparisons of properties joined by AND, not {bad[0].text()}")
    return parts


def as_cypher(q: Query) -> str:
    """MATCH over nodes named by table; left joins are optional matches."""
    q.validate()
    out = [f"MATCH ({q._alias}:{_name(str(q._anchor))})"]
    for t, a, on, how, _ in q._joins:
        m = _EQUAL.match(on)
        if not m:
            raise SemanticError(f"a relationship needs one equality, not {on!r}")
        other = m[3] if m[1] == a else m[1]
        fk = m[4] if m[1] == a else m[2]
        out.append(f"{'OPTIONAL ' if how == 'left' else ''}MATCH ({other})-[:{fk.upper()}]->({a}:{_name(str(t))})")
    cond = []
    for p in _scalars(q):
        op = p.op.upper()
        if op in ("IS NULL", "IS NOT NULL"):
            cond.append(f"{p.ref.sql()} {op}")
        elif op == "IN":
            cond.append(f"{p.ref.sql()} IN [{', '.join(map(_value, p.value))}]")
        elif op == "LIKE":
            cond.append(f"{p.ref.sql()} =~ {_value(re.sub('%', '.*', re.sub('_', '.', re.escape(p.value))))}")
        else:
            cond.append(f"{p.ref.sql()} {op} {_value(p.value)}")
    if cond:
        out.append("WHERE " + " AND ".join(cond))
    shown = [*(f"{c} AS {n}" for c, n in q._group), *(f"{e} AS {n}" for n, e in q._aggs.items())] or [q._alias, *(a for _, a, *_ in q._joins)]
    if q._having is not None:
        out += ["WITH " + ", ".join(shown), "WHERE " + condition_sql(q._having), "RETURN *"]
    else:
        out.append("RETURN " + ", ".join(shown))
    if q._order:
        out.append("ORDER BY " + ", ".join(q._order))
    if q._limit is not None:
        out.append(f"LIMIT {q._limit}")
    return "\n".join(out)


def as_sparql(q: Query, prefix: str = "http://example.org/") -> str:
    """SELECT over triples: a class for each table, a property for each column."""
    q.validate()
    var = lambda ref: "?" + ref.replace(".", "_")
    triples, used = [f"?{q._alias} a :{_name(str(q._anchor))} ."], set()
    for t, a, on, how, _ in q._joins:
        m = _EQUAL.match(on)
        if not m:
            raise SemanticError(f"a triple needs one equality, not {on!r}")
        other, fk = (m[3], m[4]) if m[1] == a else (m[1], m[2])
        line = f"?{other} :{fk} ?{a} . ?{a} a :{_name(str(t))} ."
        triples.append(f"OPTIONAL {{ {line} }}" if how == "left" else line)

    def prop(ref: str) -> str:
        if ref not in used:
            used.add(ref)
            alias, _, column = ref.partition(".")
            triples.append(f"OPTIONAL {{ ?{alias} :{column} {var(ref)} }}")
        return var(ref)

    for p in _scalars(q):
        v, op = prop(p.ref.sql()), p.op.upper()
        if op == "IS NULL":
            triples.append(f"FILTER (!BOUND({v}))")
        elif op == "IS NOT NULL":
            triples.append(f"FILTER (BOUND({v}))")
        elif op == "IN":
            triples.append(f"FILTER ({v} IN ({', '.join(map(_value, p.value))}))")
        elif op == "LIKE":
            triples.append(f"FILTER REGEX({v}, {_value('^' + re.sub('%', '.*', re.sub('_', '.', p.value)) + '$')})")
        else:
            triples.append(f"FILTER ({v} {'!=' if op == '<>' else op} {_value(p.value)})")
    refs = lambda e: re.sub(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)", lambda m: prop(m[0]), e)
    group = [prop(c) for c, _ in q._group]
    shown = [*group, *(f"({refs(e)} AS ?{n})" for n, e in q._aggs.items())] or ["*"]
    tail = (f"\nGROUP BY {' '.join(group)}" if group else "") + (f"\nLIMIT {q._limit}" if q._limit is not None else "")
    return f"PREFIX : <{prefix}>\nSELECT {' '.join(shown)} WHERE {{\n  " + "\n  ".join(triples) + "\n}" + tail
