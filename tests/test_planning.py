"""Decision diagrams, compositions, gates and advice, exports, suggestions and phrases."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from starloom.errors import GrainCompatibilityError, SemanticError, StarloomError
from starloom.operators.expr import And, Not, Or, PropRef, Raw
from starloom.operators.paths import VerbHop
from starloom.operators.query import Query
from starloom.planning import export, phrases, planner, recommend
from starloom.planning.artifact import PipelineArtifact
from starloom.planning.bdd import FALSE, TRUE, Diagrams
from starloom.planning.dag import Compositions

A, B, C = Raw("a > 1"), Raw("b = 2"), Raw("c < 3")


def test_diagrams_equal_truth_tables():
    d = Diagrams()
    forms = [A, And(A, B), Or(A, Not(B)), Or(And(A, B), And(Not(A), C)), Not(Or(A, And(B, C))), And(Or(A, B), Or(A, Not(B)))]

    def value(p, row):
        if isinstance(p, Not):
            return not value(p.arg, row)
        if isinstance(p, And):
            return all(value(x, row) for x in p.args)
        if isinstance(p, Or):
            return any(value(x, row) for x in p.args)
        return row[p.sql]

    def holds(f, row):
        return any(all(row[k.strip("()")] == v for k, v in m.items()) for m in d.models(f))

    rows = [dict(zip(("a > 1", "b = 2", "c < 3"), bits)) for bits in itertools.product((False, True), repeat=3)]
    for p, q in itertools.product(forms, repeat=2):
        f, g = d.of(p), d.of(q)
        assert (f == g) == all(value(p, r) == value(q, r) for r in rows)
        assert d.implies(f, g) == all(not value(p, r) or value(q, r) for r in rows)
        assert all(holds(d.both(f, g), r) == (value(p, r) and value(q, r)) for r in rows)
    assert d.of(And(A, Not(A))) == FALSE and d.of(Or(A, Not(A))) == TRUE and d.of(forms[-1]) == d.of(A)
    assert d.size(d.of(A)) == 1 and d.sql(TRUE) == "TRUE"


def test_diagrams_as_sql(spark):
    df = spark.createDataFrame([(a, b, c) for a in (1, 2) for b in (1, 2) for c in (2, 3)], "a int, b int, c int")
    d = Diagrams()
    for p in (And(A, B), Or(A, Not(B)), Or(And(A, B), And(Not(A), C)), Not(Or(A, And(B, C)))):
        assert sorted(df.filter(d.sql(d.of(p))).collect()) == sorted(df.filter(p.column()).collect())


def test_compositions(spark):
    c = Compositions()
    x, y, z = c.leaf("x"), c.leaf("y"), c.leaf("z")
    assert c.union(x, y) == c.union(y, x, x, c.EMPTY) and c.intersect(x, c.TOP) == x and c.union(x, c.TOP) == c.TOP
    assert c.union(c.union(x, y), z) == c.union(x, c.union(y, z)) and c.intersect(x, c.EMPTY) == c.EMPTY
    assert c.union(x, c.intersect(x, y)) == x and c.intersect(x, c.union(x, y)) == x and c.minus(x, x) == c.EMPTY
    low, high = c.leaf("t", "t", "v < 3"), c.leaf("t", "t", "NOT (v < 3)")
    assert c.intersect(low, high) == c.EMPTY and c.condition(c.union(low, high)) == ("t", "TRUE")
    tables = {"t": spark.range(6).selectExpr("id as v"), "x": spark.range(4).selectExpr("id as v"), "y": spark.range(2, 6).selectExpr("id as v")}
    both = c.intersect(x, y)
    one, two = c.union(both, low), c.minus(both, c.leaf("z2"))
    tables["z2"] = spark.range(3, 4).selectExpr("id as v")
    assert both in c.shared(one, two)
    a, b = c.run(tables, one, two)
    assert sorted(r.v for r in a.collect()) == [0, 1, 2, 3] and [r.v for r in b.collect()] == [2]
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    assert sorted(r.v for r in spark.sql(c.sql(one)).collect()) == [0, 1, 2, 3]


def _query():
    return Query().anchor("orders", "o").path_join(VerbHop("customer", "c", "c.id = o.customer_id"))


def test_guards():
    with pytest.raises(SemanticError):
        _query().measures({"o.price": False}).aggregate([], t="sum(o.price)").validate()
    _query().measures({"o.price": False, "o.total": True}).aggregate([], t="sum(o.total)", a="avg(o.price)").validate()
    with pytest.raises(GrainCompatibilityError):
        _query().facts({"orders": "order", "lines": "line"})
    _query().facts({"orders": "order", "lines": None})


def test_gate_and_advice(spark):
    df = spark.range(1000)
    gate = planner.Gate(budget=planner.size_in_bytes(df) * 2)
    assert gate.decide(df).action == planner.PROCEED and gate.decide(df, rows=5000).action == planner.STREAM
    tight = planner.Gate(budget=planner.size_in_bytes(df) * 2 // 3)
    assert tight.decide(df).action == planner.PAGINATE and tight.decide(df, approximate=True, rows=10**9).action == planner.SAMPLE
    assert planner.Gate(budget=10).decide(df).action == planner.REJECT
    assert planner.sampling_error(planner.sampling_fraction(10**9, 0.01), 10**9) == pytest.approx(0.01)
    never = _query().where(Raw("o.a = 1")).where(~Raw("o.a = 1"))
    assert gate.decide(df, never).action == planner.REWRITE and gate.run(df, gate.decide(df, never)) == []
    assert len(list(gate.run(df, gate.decide(df, rows=5000)))) == 1000
    shape = planner.shape(df.groupBy((F.col("id") % 7).alias("k")).count())
    assert shape.exchanges == 1 and shape.joins == 0
    told = {a.rule for a in planner.advise(_query().where(PropRef("c.name") == "x").where(PropRef("c.name") == "x").window(r="rank() OVER (ORDER BY o.a)").order_by("r"), {"customer": 100})}
    assert {"repeated", "broadcast", "inner", "one task", "order"} <= told
    assert [a.rule for a in planner.advise(never)] == ["empty"]


def test_exports():
    q = _query().where((PropRef("c.segment") == "x'y") & (PropRef("o.total") > 5)).group_by("c.segment").agg(n="count(*)").limit(3)
    assert json.loads(export.as_json(q))["aggregates"] == {"n": "count(*)"}
    assert 'segment"' in export.as_yaml(q) and "joins:\n  - table: " in export.as_yaml(q)
    cypher = export.as_cypher(q).splitlines()
    assert cypher[:2] == ["MATCH (o:Orders)", "OPTIONAL MATCH (o)-[:CUSTOMER_ID]->(c:Customer)"] and cypher[-1] == "LIMIT 3" and "c.segment = 'x\\'y' AND o.total > 5" in cypher[2]
    sparql = export.as_sparql(q)
    assert "?o :customer_id ?c ." in sparql and "FILTER (?o_total > 5)" in sparql and sparql.endswith("GROUP BY ?c_segment\nLIMIT 3")
    with pytest.raises(SemanticError):
        export.as_cypher(_query().where(Raw("o.a = 1 OR o.b = 2")))


def test_artifacts():
    a = PipelineArtifact("sales", time="day", unit="month", key=("id",)).to("building").to("fresh").to("stale", "late rows")
    assert a.write_mode() == "merge" and a.history[-1] == ("stale", "late rows")
    with pytest.raises(StarloomError):
        a.to("fresh")
    assert PipelineArtifact("log", append_only=True).write_mode() == "append" and PipelineArtifact("x").backfill("a", "b") == "TRUE"


def test_backfill_condition(spark):
    a = PipelineArtifact("sales", time="day", unit="month")
    df = spark.sql("select explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-04-30', interval 1 day)) as day")
    hit = df.filter(a.backfill("2024-02-10", "2024-03-01")).agg(F.min("day"), F.max("day")).first()
    assert [str(x)[:10] for x in hit] == ["2024-02-01", "2024-02-29"]


def test_suggestions_and_phrases():
    cols = [recommend.Column("s", "revenue", additive=True), recommend.Column("s", "price", additive=False, grain="line"), recommend.Column("d", "day", temporal=True, grain="day")]
    assert recommend.stage([10, 0, 0]) == "focus" and recommend.stage([5, 5, 4]) == "explore"
    trail = recommend.Trail().add("group", "s.price").add("filter", "d.day")
    assert recommend.suggest(cols, trail)[0].kind == "grain" and recommend.suggest(cols, trail, [5, 5])[0].kind in ("sum", "average")
    assert phrases.band("total revenue per region") == "aggregate" and phrases.band("top 5 customers") == "window" and phrases.band("only retail") == "filter" and phrases.band("customers") == "context"
    assert phrases.temporal("sales year to date") == "to_date" and phrases.temporal("past 30 days") == "rolling" and phrases.composition("buyers but not sellers") == "except"
    names = phrases.Entities().add("sales.revenue", "turnover").add("customer").add("sales.order_date")
    assert names.find("turnover of custmers by order date") == ["sales.revenue", "customer", "sales.order_date"]
