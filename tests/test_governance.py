"""Contracts and versions, lineage, migrations, watching, layers, settings, made-up data, sources and the command line."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom import cli
from starloom.config import Config
from starloom.errors import ContractError, DestructiveMigrationError, KeyResolutionError, LoadError, MigrationError, SchemaError, SemanticError, StarloomError
from starloom.governance import layers, lineage, migrations, registry, watch
from starloom.operators import communities, contracts, graph, hierarchy, schema_graph, warehouse
from starloom.plans import observatory
from starloom.sources import external
from starloom.sources.table import VersionedTable
from starloom.synthetic import ChangeRule, Dataset, EntitySchema, EventSpec, FieldSpec

S = lambda text: T._parse_datatype_string(text)


def test_contract_registry(spark):
    c = registry.DataContract("orders", S("id bigint, v string"), (contracts.not_null("v"),))
    r = registry.Registry()
    r.register(c)
    wider, change = c.evolved(S("id bigint, v string, w int"))
    assert str(wider.version) == "1.1.0" and change.is_safe
    r.register(wider)
    broken, _ = wider.evolved(S("id bigint"))
    assert str(broken.version) == "2.0.0"
    with pytest.raises(ContractError):
        r.register(registry.DataContract("orders", S("id bigint"), version=registry.Version(1, 2)))
    r.register(broken)
    assert r.get("orders").version.major == 2 and str(r.get("orders", "1.0.0").version) == "1.1.0"
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")
    report = c.check(df)
    assert report.has_errors and "NOT_NULL" in report.summary() and report.to_dict()["version"] == "1.0.0"
    seen = []
    with pytest.raises(ContractError):
        registry.gated(df, c, lambda kind, d: seen.append(kind))
    assert registry.gated(df.filter("v is not null"), c, lambda kind, d: seen.append(kind)).count() == 1 and seen == ["failed", "passed"]
    good, bad = registry.split(df, c, {"has v": "v is not null", "small": "id < 2"})
    assert good.count() == 1 and bad.first().reasons == ["has v", "small"]
    assert registry.SLA(pass_rate=0.5).met(1, 2) and not registry.SLA().met(1, 2)


def test_lineage(spark, tmp_path):
    g = lineage.Graph(lineage.declared("gold", {"total": ["silver.a", "silver.b"]})).add(lineage.declared("silver", {"a": ["bronze.x"]}))
    assert g.upstream("gold.total") == {"silver.a", "silver.b", "bronze.x"} and g.downstream("bronze.x") == {"silver.a", "gold.total"}
    assert "silver_a" in g.to_mermaid()
    spark.range(3).selectExpr("id as k", "id * 2 as v").write.parquet(f"{tmp_path}/src.parquet")
    a = spark.read.parquet(f"{tmp_path}/src.parquet")
    edges = lineage.of_plan(a.union(a.selectExpr("v", "k")).groupBy("k").agg(F.max("v").alias("m")), "t")
    assert {(e.source, e.target) for e in edges} >= {("src.k", "t.k"), ("src.v", "t.m")}

    def bad(event):
        raise ValueError("down")

    got = []
    e = lineage.Emitter(bad, got.append, lineage.into_folder(spark, f"file://{tmp_path}/events"))
    e.named("load")("started", {"rows": 1})
    assert got[0].kind == "started" and "down" in e.errors[0] and spark.read.json(f"{tmp_path}/events").first().job == "load"


def test_migrations(spark, tmp_path):
    m = migrations.Model("d", {"id": "bigint", "name": "string"}, ("id",))
    t = VersionedTable(spark, f"{tmp_path}/d")
    assert [s.kind for s in migrations.migrate(t, m, "2024-01-01")] == ["create"] and migrations.migrate(t, m, "2024-01-01") == []
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string"))
    wide = migrations.Model("d", {"id": "bigint", "name": "string", "rank": "int"}, ("id",), 2, {"rank": 7})
    assert {s.kind for s in migrations.migrate(t, wide, "2024-01-01")} == {"version", "add"}
    assert t.read().filter("is_current and rank = 7").count() == 2 and migrations.migrate(t, wide, "2024-01-01") == []
    flat = migrations.Model("d", {"id": "int", "rank": "int"}, ("rank",))
    with pytest.raises(DestructiveMigrationError):
        migrations.migrate(t, flat, "2024-01-01")
    with pytest.raises(MigrationError):
        migrations.migrate(t, flat, "2024-01-01", ("id",), allow_destructive=True)  # rank doesn't tell rows apart
    steps = migrations.difference(flat, t.read().schema)
    assert {s.kind for s in steps} == {"flatten", "type", "drop"} and "-- destructive\nALTER TABLE d DROP COLUMN name;" in migrations.script(flat, steps)


def test_watching(spark, tmp_path):
    lines = []
    c = watch.Collector(watch.to_json_lines(lines.append))

    @c.traced(kind="load")
    def work(n):
        with c.span("inner"):
            return 1 / n

    work(1)
    with pytest.raises(ZeroDivisionError):
        work(0)
    assert [s.name for s in c.spans] == ["inner", "work"] * 2 and c.spans[0].parent == c.spans[1].id and "ZeroDivision" in c.spans[3].error
    assert c.counters[("failures", ("span", "work"))] == 1 and len(c.values[("seconds", ("span", "work"))]) == 2 and json.loads(lines[0])["name"] == "inner"
    c.counted(spark.range(5), "five").collect()
    assert c.observed("five") == 5

    o = watch.Observatory(spark, f"{tmp_path}/watch")
    change = contracts.evolution(S("a int, b bigint"), S("a bigint, c string"))
    assert o.ingest_evolution("orders", "silver", change, "2024-01-01", "e-1") == 3 and o.ingest_evolution("orders", "silver", change, "2024-01-01", "e-1") == 3
    assert o.ingest_quality("orders", "silver", [{"rule": "NOT_NULL", "severity": "error", "violations": 4}], "2024-01-02") == 1
    assert watch.Observatory(spark, f"{tmp_path}/watch")["changes"].count() == 3 and o["datasets"].count() == 1
    rate = observatory.breaking_change_rate(o["changes"], o["datasets"], o["kinds"]).first()
    assert (rate.total_changes, rate.breaking_changes) == (3, 1)
    assert observatory.worst_quality(o["checks"], o["datasets"]).first().total_violations == 4


def test_notices():
    now, told = [0.0], []

    def down(n):
        raise OSError("no line")

    rule = watch.Rule("breaking", lambda e: e["kind"] == "failed", ("mail", "phone"), "P2", escalate_after=10, quiet=5)
    r = watch.Router({"mail": told.append, "phone": down}, [rule], lambda: now[0])
    assert len(r.route({"kind": "failed", "subject": "x"})) == 2 and len(r.failed) == 1
    assert r.route({"kind": "failed", "subject": "x"}) == [] and r.route({"kind": "passed"}) == []
    now[0] = 11
    assert [n.priority for n in r.escalate()] == ["P1"] and r.escalate() == []


def test_layers(spark, tmp_path):
    c = registry.DataContract("orders", S("id bigint"), (contracts.no_duplicates("id"),))
    x = layers.Layered(spark, str(tmp_path), {("silver", "orders"): c})
    x.table("bronze", "orders").write(spark.createDataFrame([(1,), (1,)], "id bigint"))
    with pytest.raises(ContractError):
        x.promote("orders", "bronze", "silver")
    x.promote("orders", "bronze", "silver", lambda df: df.distinct())
    assert x.table("silver", "orders").read().count() == 1 and layers.next_layer("semantic") is None
    with pytest.raises(SchemaError):
        x.promote("orders", "bronze", "gold")


def test_settings(spark):
    c = Config.load({"STARLOOM_BATCH_SIZE": "5", "STARLOOM_ALLOW_DESTRUCTIVE": "yes"}, checksum="sha256")
    assert (c.batch_size, c.allow_destructive, c.checksum) == (5, True, "sha256") and c.spark()["spark.sql.adaptive.enabled"] == "true"
    assert len(spark.range(1).select(c.hashed(F.lit("x"))).first()[0]) == 64
    for env in ({"STARLOOM_BATCH_SIZE": "x"}, {"STARLOOM_CHECKSUM": "crc"}):
        with pytest.raises(StarloomError):
            Config.load(env)


def test_made_up_data(spark):
    d = Dataset(
        [EntitySchema("cust", 200, (FieldSpec("id", "sequence", 1), FieldSpec("seg", "choice", choices=("a", "b"), weights=(9, 1)), FieldSpec("x", "decimal", 5, 6, null_rate=0.5)), (ChangeRule(0.5, "seg", "'z'"), ChangeRule(0.1))), EntitySchema("orders", 500, (FieldSpec("id", "sequence"), FieldSpec("cust", "reference", of="cust"), FieldSpec("d", "date", 0, 10)))],
        [EventSpec("clicks", "cust", 3, ("view", "buy"))],
    )
    f = d.frames(spark)
    assert f["cust"].agg(F.min("id"), F.max("id")).first() == (1, 200) and 0.8 < f["cust"].filter("seg = 'a'").count() / 200 < 1
    assert 60 < f["cust"].filter("x is null").count() < 140 and f["orders"].filter("cust >= 0 and cust < 200").count() == 500 and f["clicks"].count() == 600
    assert sorted(map(str, f["cust"].repartition(5).collect())) == sorted(map(str, d.frames(spark)["cust"].collect()))
    later = d.changed(spark, "cust", 2)
    assert 120 < later.count() < 190 and later.filter("seg = 'z'").count() > 60
    with pytest.raises(SchemaError):
        Dataset([EntitySchema("o", 1, (FieldSpec("c", "reference", of="none"),))]).frames(spark)


def test_external_sources(spark, tmp_path):
    got = external.iterated(lambda part: ({"k": part, "v": str(i)} for i in range(3)), "k int, v string", 4)(spark)
    assert got.count() == 12 and got.filter("k = 2").count() == 3
    assert external.resource(lambda: [{"a": 1}])(spark).first().a == 1
    assert external.bridge(lambda: {"t": [{"a": 1}, {"a": 2}]}, "t")(spark).count() == 2
    for bad in (external.bridge(lambda: {}, "t"), external.resource(lambda: [])):
        with pytest.raises(LoadError):
            bad(spark)
    with external.CatalogTable(spark, str(tmp_path / "c"), "named_t") as t:
        t.write(spark.range(3))
        t.write(spark.range(2))
        assert spark.table("named_t").count() == 5
    spark.range(4).write.parquet(f"{tmp_path}/n.parquet")
    with external.of_folder(spark, str(tmp_path), ["n"]) as s:
        assert s.sql("select count(*) as n from n").first().n == 4 and s.schemas() == {"n": {"id": "bigint"}}
    with pytest.raises(LoadError):
        s.sql("select 1")


def test_sharded_stream(spark, tmp_path):
    class Shards:
        """A record store for the stream's test: two shards of JSON texts."""

        def shards(self):
            return ["a", "b"]

        def latest(self, shard):
            return {"a": 3, "b": 2}[shard]

        def records(self, shard, start, end):
            return [json.dumps({"s": shard, "n": i}) for i in range(start, end)]

    stream = external.sharded(Shards, "s string, n int")(spark)
    stream.writeStream.format("memory").queryName("shards_out").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.table("shards_out").collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_jdbc_statements(spark, monkeypatch):
    said, written = [], []
    t = external.JdbcTable("jdbc:x", "dim", said.append)
    monkeypatch.setattr(t, "_written", lambda df, table, mode: written.append((table, mode, df.columns)))
    rows = spark.createDataFrame([(1, "a")], "id bigint, v string")
    t.write(rows)
    t.update_attributes(rows, ["id"], ["v"])
    t.rotate_attributes(rows, ["id"], [("v", "before")])
    assert written[0] == ("dim", "append", ["id", "v"]) and written[1][0] == "dim_stage" and len(said) == 4
    assert said[0] == "UPDATE dim AS t SET v = s.v FROM dim_stage AS s WHERE t.is_current AND s.id = t.id" and "before = t.v, v = s.v" in said[2]


def test_warehouse_order_and_keys(spark, tmp_path):
    E, R = warehouse.Entity, warehouse.Reference
    order = warehouse.build_order([E("g", "graph"), E("f", references=(R("c", "d2", "k"),)), E("d2", "dimension", references=(R("x", "d1", "k"),)), E("d1", "dimension")])
    assert [e.name for e in order] == ["d1", "d2", "f", "g"]
    for bad in ([E("a", references=(R("c", "none", "k"),))], [E("a", "dimension", references=(R("c", "b", "k"),)), E("b", "dimension", references=(R("c", "a", "k"),))], [E("d", "dimension", references=(R("c", "f", "k"),)), E("f")], [E("a", "cube")]):
        with pytest.raises(SchemaError):
            warehouse.build_order(bad)
    assert warehouse.inferred_strategy(E("d", "dimension", tracked=("v",))) == "scd2" and warehouse.inferred_strategy(E("f", options={"milestones": ["a"]})) == "accumulating"
    t = VersionedTable(spark, str(tmp_path / "d"))
    t.write(spark.sql("select 1L as id, 'a' as code, true as is_current, false as is_inferred, timestamp_ntz'2020-01-01' as valid_from, cast(null as timestamp_ntz) as valid_to"))
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    with pytest.raises(KeyResolutionError):
        warehouse.Resolver(t, R("c", "d", "code", missing="raise"))(rows, "2024-01-01", "x")
    assert warehouse.Resolver(t, R("c", "d", "code", missing="null"))(rows, "2024-01-01", "x").filter("c_sk is null").count() == 2
    told = []
    out = warehouse.Resolver(t, R("c", "d", "code"), lambda d, n: told.append((d, n)))(rows, "2024-01-01", "x")
    assert sorted((r.c or "", r.c_sk) for r in out.collect()) == [("", None), ("a", 1), ("b", 2)] and told == [("d", 1)]


def test_schema_graph(spark):
    v = [schema_graph.Vertex("p", "people", "id", ("name",)), schema_graph.Vertex("c", "cities", "id")]
    e = [schema_graph.EdgeType("lives", "lives", "p", "pid", "c", "cid", {"days": True, "rate": False}, "person", "at"), schema_graph.EdgeType("works", "lives", "p", "pid", "c", "wid", grain="job", role="work")]
    s = schema_graph.SchemaGraph(v, e)
    assert s.validate() == [] and s.forward()["p"] == [("lives", "c"), ("works", "c")] and s.transposed()["c"] == [("lives", "p"), ("works", "p")]
    assert s.roles() == {"lives": ["lives", "works"]} and "p -->|lives| c" in s.to_mermaid()
    assert s.difference(schema_graph.SchemaGraph(v, e[:1]))["removed_edges"] == ["works"]
    assert schema_graph.SchemaGraph(v[:1], e[:1]).validate() == ["lives: no vertex c"]
    with pytest.raises(Exception, match="person"):
        s.check_grains("lives", "works")
    people = spark.createDataFrame([(1, "ann"), (2, None)], "id bigint, name string")
    lives = spark.createDataFrame([(1, 7, 8, 30, 0.5, "2024-01-01"), (2, 7, 9, 10, 0.1, "2024-02-01")], "pid bigint, cid bigint, wid bigint, days bigint, rate double, at string")
    m = schema_graph.GraphModel(s, {"people": people, "lives": lives, "cities": people})
    assert m.by_key("p", "ann").first().id == 1 and m.by_key("p", None).first().id == 2
    assert m.aggregate("lives", "sum", "days", "in").first().value == 40 and m.freshness("lives").first().fresh == "2024-02-01" and m.freshness("works") is None
    assert m.neighbors("lives", spark.createDataFrame([(1,)], "id bigint")).first().neighbor == 7 and m.degree("works").count() == 4 and "Aggregate" in m.explain("degree", "lives")
    for wrong in (lambda: m.aggregate("lives", "sum", "rate"), lambda: m.aggregate("lives", "sum", "none"), lambda: m.explain("drop")):
        with pytest.raises(SemanticError):
            wrong()


def test_communities_and_flow(spark):
    inside = [(a, b) for g in (0, 10, 20) for a in range(g, g + 6) for b in range(a + 1, g + 6)]
    e = spark.createDataFrame([*inside, (5, 10), (15, 20)], "src bigint, dst bigint")
    got = communities.louvain(e)
    assert {(r.id, r.community) for r in got.collect()} == {(i, i // 10 * 10) for g in (0, 10, 20) for i in range(g, g + 6)}
    assert communities.modularity(e, got) > 0.5 and communities.louvain(e.limit(0)).count() == 0
    with pytest.raises(SemanticError):
        communities.community_label(e, "none")
    w = spark.createDataFrame([(1, 2, 3.0), (1, 3, 2.0), (2, 3, 5.0), (2, 4, 2.0), (3, 4, 3.0), (8, 9, 1.0)], "src bigint, dst bigint, w double")
    assert communities.max_flow(w, 1, 4).first().flow == 5 and communities.max_flow(w, 1, 9).first().flow == 0
    with pytest.raises(SemanticError):
        communities.max_flow(w, 1, 4, most_edges=2)
    assert communities.scoped_edges(w, None, None)[0] == "FF" and communities.scoped_edges(w, spark.createDataFrame([(2,)], "id bigint"))[1].count() == 3
    assert graph.degree(w).count() == 6


def test_trees(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3)]
    t = hierarchy.Tree(spark.createDataFrame(rows, "id bigint, up bigint"), "id", parent="up")
    assert t.strategy == "adjacency" and t.ancestors(spark.createDataFrame([(4,)], "descendant bigint"), 2).count() == 2 and t.level(0).first()[0] == 1
    with pytest.raises(SchemaError):
        hierarchy.adjacency_closure(spark.createDataFrame([(1, 2), (2, 1)], "id bigint, up bigint"), "id", "up")
    with pytest.raises(SchemaError):
        hierarchy.Tree(t.nodes, "id")
    j = hierarchy.junk_spec("Flags", gift=[True, False], way=["a", "b", "c"])
    assert j.__name__ == "Flags" and sorted(r.id for r in j.rows(spark).collect()) == [1, 2, 3, 4, 5, 6]


def test_command_line(spark, tmp_path):
    out = []
    assert cli.main(["queries"], out=out.append) == 0 and any(x.startswith("scd2") for x in out)
    assert cli.main(["run", "none", "--data", "x"], spark, out.append) == 2
    out.clear()
    cli.main(["ask", "total revenue per segment", "--names", "sales.revenue", "customer.segment"], out=out.append)
    assert json.loads(out[0]) == {"band": "aggregate", "time": None, "composition": None, "entities": ["sales.revenue", "customer.segment"]}
