"""Sources, transforms, contracts, the algebra, and streams into versioned tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.errors import ContractError, LoadError, SemanticError, TransformTypeError
from starloom.functions import columns, transforms
from starloom.operators import contracts
from starloom.operators.algebra import QuestionAlgebra
from starloom.sources import readers
from starloom.sources.table import VersionedTable
from starloom.streaming import apply as streams


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, " Ann "), (2, None), (2, "Bob")], "id bigint, name string")


def test_readers(spark, people, tmp_path):
    p, c = str(tmp_path / "p.parquet"), str(tmp_path / "c.csv")
    people.write.parquet(p)
    people.write.option("header", True).csv(c)
    assert readers.coerce(p)(spark).count() == 3
    assert readers.coerce(c)(spark).columns == ["id", "name"]
    assert readers.parquet(p, file_name="file")(spark).select("file").distinct().count() >= 1
    people.createOrReplaceTempView("people_v")
    assert readers.coerce("people_v")(spark).count() == 3
    assert readers.query("select count(*) as n from people_v;")(spark).first().n == 3
    assert readers.rows([{"a": 1}])(spark).first().a == 1
    for bad in ([], 5):
        with pytest.raises(LoadError):
            readers.rows(bad)(spark)
    with pytest.raises(LoadError):
        readers.table("a.b", "c")


def test_transforms(people):
    got = transforms.apply(people, [transforms.on("name").strip().fill_null("?"), transforms.on("id").cast("string")])
    assert sorted(map(tuple, got.collect())) == [("1", "Ann"), ("2", "?"), ("2", "Bob")]
    assert transforms.apply(people, [transforms.on("name").drop_nulls()]).count() == 2
    for wrong in ("id", "none"):
        with pytest.raises(TransformTypeError):
            transforms.apply(people, [transforms.on(wrong).upper()])


def test_column_functions(spark):
    df = spark.sql("select array(3, 1, null) as a, cast(null as array<int>) as n, timestamp_ntz'2024-01-31 23:00:00' as x, timestamp_ntz'2024-04-01' as y, 'k7' as s, 6 as b")
    c = columns
    row = df.select(c.list_first("a"), c.list_last("a"), c.list_count("n"), c.list_sum("a"), c.list_appended("n", "b"), c.days_between("x", "y"), c.units_between("quarter", "x", "y"), c.units_between("year", "x", "y"), c.try_cast("s", "int"), c.bits_set("b"), c.bit_is_set("b", 1), c.matches("s", "[0-9]$"), c.formatted("%s-%03d", "s", "b"), c.differs(F.lit(None), F.lit(None)), c.int_range(2, 4), c.int_range(2, 2)).first()
    assert tuple(row) == (3, None, 0, 4.0, [6], 61, 1, 0, None, 2, True, True, "k7-006", False, [2, 3], []) and c.bit_mask(1, 2, 2) == 6
    assert [tuple(r) for r in c.unnested(df.select("s", "a"), "a", "v", "i").collect()] == [("k7", 1, 3), ("k7", 2, 1), ("k7", 3, None)]


def test_contracts(people):
    rules = [contracts.not_null("name"), contracts.no_duplicates("id"), contracts.column_exists("id"), contracts.type_match("id", "string")]
    assert {r.rule: r.violations for r in contracts.report(people, rules).collect()} == {"NOT_NULL": 1, "NO_DUPLICATES": 1, "TYPE_MATCH": 1}
    assert contracts.report(people.limit(0), rules[:3]).count() == 0 and contracts.report(people, []).count() == 0
    with pytest.raises(ContractError):
        contracts.gate(people, rules)
    assert contracts.gate(people, [contracts.not_null("id")]) is people


def test_evolution():
    f = T.StructField
    old = T.StructType([f("a", T.IntegerType()), f("b", T.LongType()), f("c", T.StringType()), f("d", T.StringType())])
    new = T.StructType([f("a", T.LongType()), f("b", T.IntegerType()), f("c", T.LongType()), f("e", T.StringType()), f("g", T.StringType(), False)])
    e = contracts.evolution(old, new)
    assert e.safe == [("added", "e")] and e.additive == [("widened", "a"), ("added", "g")]
    assert e.breaking == [("narrowed", "b"), ("type_changed", "c"), ("removed", "d")] and not e.is_safe and contracts.evolution(old, old).is_safe


def test_algebra(people):
    q = QuestionAlgebra().add("a", people).add("b", people.filter("id = 2"))
    assert q.compose("a", "join", "b", "j", "l.id = r.id")["j"].columns == ["id", "name", "r_id", "r_name"]
    assert q.empty("a").count() == 0 and q.suggestions({"a": "people", "b": "people"}) == [("a", "b")]
    for left, op, right, name in (("a", "union", "b", "a"), ("a", "join", "b", "k"), ("a", "and", "b", "m"), ("a", "union", "z", "n")):
        with pytest.raises(SemanticError):
            q.compose(left, op, right, name)


def test_stream_into_table(spark, tmp_path):
    schema, kept = "id bigint, v string, at bigint", str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.parquet(kept)
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([], "id bigint, v string, at bigint"))

    def run():
        q, seen = streams.into_table(streams.files(spark, "parquet", kept, schema), table, lambda t, rows, change: t.upsert(rows, ["id"], change), str(tmp_path / "cp"), keys=["id"], deduplicate_by="at")
        q.awaitTermination()
        return seen.batches

    assert run() == 1 and sorted((r.id, r.v) for r in table.read().collect()) == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, "d", 5)], schema).coalesce(1).write.mode("append").parquet(kept)
    assert run() == 1 and run() == 0
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "b"), (2, "d")]


def test_table_versions(spark, people, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), partition_by=("id",))
    assert t.write(people) == 1 and t.write(people.limit(1), "s-3") == 2
    assert t.write(people, "s-3") == t.write(people, "s-2") == 2 and t.write(people, "one") == 3
    for i in range(4, 9):
        t.write(people.limit(1), f"s-{i}")
    assert t.write(people, "s-3") == t.write(people, "one") == 8  # replays long after are still known
    assert t.read(1).count() == 3 and t.read(2).count() == 4 and t.read().count() == 12 and t.read().columns == ["id", "name"]
    assert len(t.details()["folders"]) == 8
    t.write_named(people.withColumn("extra", F.lit(5)), ["id", "extra"])
    assert t.read().filter("extra = 5 and name is null").count() == 3 and t.read().filter("extra is null").count() == 12
    assert t.compact(2) == 10 and t.read().count() == 15 and len(t.details()["folders"]) == 1
    assert t.vacuum(2, older_than_seconds=0) == list(range(1, 9)) and t.versions() == [9, 10] and t.read(9).count() == t.read().count() == 15
    with pytest.raises(LoadError):
        t.read(3)
    with pytest.raises(LoadError):
        t.write(people)  # lacks a column by now


def test_table_of_two_writers(spark, people, tmp_path, monkeypatch):
    """The second one of two writers that have seen the same version fails and loses nothing of the first one's."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(people)
    seen = t.details()
    t.write(people.limit(1), "first")
    with pytest.raises(LoadError):
        t._commit(seen, people, "second", True)
    assert t.versions() == [1, 2] and t.read().count() == 4
    assert t.write(people, "second") == 3 and t.read().count() == 7


def test_attribute_changes(spark, tmp_path):
    rows = [(1, "a", None, True), (1, "z", None, False), (2, "b", None, True)]
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame(rows, "id bigint, v string, before string, is_current boolean"))
    new = spark.createDataFrame([(1, "c"), (9, "q")], "id bigint, v string")
    t.update_attributes(new, ["id"], ["v"])
    assert sorted(map(tuple, t.read().select("id", "v", "is_current").collect())) == [(1, "c", True), (1, "z", False), (2, "b", True)]
    t.rotate_attributes(spark.createDataFrame([(2, "d")], "id bigint, v string"), ["id"], [("v", "before")])
    assert sorted(map(tuple, t.read().filter("is_current").select("id", "v", "before").collect())) == [(1, "c", None), (2, "d", "b")]
    mini = VersionedTable(spark, str(tmp_path / "m"))
    mini.write(spark.createDataFrame([(1, "x")], "id bigint, band string"))
    got = mini.upsert_members(spark.createDataFrame([("y",), ("x",), ("y",)], "band string"), ["band"])
    assert sorted(map(tuple, got.collect())) == [("x", 1), ("y", 2)]


@pytest.mark.parametrize("kind", [1, 2, 3, 6, "metadata"])
def test_dimension_streams(spark, tmp_path, kind):
    from starloom.operators import scd

    audit = "checksum string, is_current boolean, valid_from timestamp_ntz, valid_to timestamp_ntz"
    bag = "id bigint, metadata string, metadata_diff string, row_hash string, is_current boolean, valid_from timestamp_ntz, valid_to timestamp_ntz"
    start = spark.createDataFrame([], bag if kind == "metadata" else f"id bigint, v string, old string, {audit}")
    tracked = {3: [("v", "old")], 6: (["old"], ["v"])}.get(kind, ["v"])
    table, folder = VersionedTable(spark, str(tmp_path / "t")), str(tmp_path / "in")
    table.write(start)
    want = start
    for day, rows in enumerate([[(1, "a", "p"), (2, "b", "p")], [(1, "c", "p"), (3, "d", "p")], [(1, "c", "q")]], 1):
        batch = spark.createDataFrame(rows, "id bigint, v string, old string")
        batch.coalesce(1).write.mode("append").parquet(folder)
        batch = batch if kind in (6, "metadata") else batch.drop("old")
        want = scd.applied(kind, want, batch, ["id"], tracked, f"2024-01-0{day}")
        source = streams.files(spark, "parquet", folder, "id bigint, v string, old string")
        q, seen = streams.dimension(source if kind in (6, "metadata") else source.drop("old"), table, kind, ["id"], tracked, lambda day=day: f"2024-01-0{day}", str(tmp_path / "cp"))
        q.awaitTermination()
        assert seen.ok and seen.batches == 1 and seen.rows == len(rows)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))


def test_fact_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("k1", 5), ("k9", 7), (None, 1)], "code string, v bigint").coalesce(1).write.parquet(folder)
    dim = VersionedTable(spark, str(tmp_path / "d"))
    dim.write(spark.sql("select 1L as id, 'k1' as code, true as is_current, false as is_inferred, timestamp_ntz'2020-01-01' as valid_from, cast(null as timestamp_ntz) as valid_to"))
    facts = VersionedTable(spark, str(tmp_path / "f"))
    source = lambda: streams.files(spark, "parquet", folder, "code string, v bigint")
    q, seen = streams.facts(source(), facts, [streams.Member("code", dim, "code")], lambda: "2024-01-01", str(tmp_path / "c1"))
    q.awaitTermination()
    assert sorted((r.v, r.code_sk) for r in facts.read().collect()) == [(1, None), (5, 1), (7, 2)]
    assert dim.read().filter("is_inferred").select("code").collect() == [("k9",)]
    for make, more in ((lambda t: streams.transactions(source(), t, str(tmp_path / "c2"), name="x"), []), (lambda t: streams.snapshots(source(), t, lambda: "2024-02-01", str(tmp_path / "c3")), ["snapshot_date"])):
        t = VersionedTable(spark, str(tmp_path / f"t{len(more)}"))
        q, seen = make(t)
        q.awaitTermination()
        assert seen.rows == 3 and t.read().columns == ["code", "v", *more]

    def bad(table, rows, change):
        raise ValueError("no")

    q, seen = streams.into_table(source(), facts, bad, str(tmp_path / "c4"), skip_failures=True)
    q.awaitTermination()
    assert seen.failed == 1 and not seen.ok and "no" in seen.errors[0] and facts.read().count() == 3


def test_windows(spark):
    e = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts union all select timestamp_ntz'2024-01-01 00:50:00' union all select timestamp_ntz'2024-01-01 03:00:00'")
    assert sorted(r.n for r in streams.windowed(e, "ts", "1 hour", F.count("*").alias("n")).collect()) == [1, 2]
    assert sorted(r.n for r in streams.sessions(e, "ts", "1 hour", F.count("*").alias("n")).collect()) == [1, 2]
