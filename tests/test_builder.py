import pytest
from pyspark.sql import Row

from starloom.errors import SemanticError
from starloom.operators.expr import AggRef, PropRef, WinRef, scoped
from starloom.operators.paths import PathPred, VerbHop, VerbHopInverse
from starloom.operators.query import Query
from starloom.operators.scd import deduplicated, row_hash, scd2
from starloom.sources.table import VersionedTable


@pytest.fixture(scope="module")
def star(spark):
    c = spark.createDataFrame([Row(id=1, name="Alice", segment="retail"), Row(id=2, name="Bob", segment="wholesale"), Row(id=3, name="Carol", segment="retail")])
    f = [(1, 1, 1, 1500.0), (2, 1, 2, 200.0), (3, 1, 3, 3500.0), (4, 2, 1, 4000.0), (5, 3, 1, 2000.0), (6, 3, 3, 600.0)]
    return {"customer": c, "sales": spark.createDataFrame(f, "id int, customer_id int, product_id int, revenue double")}


def test_three_bands(spark, star):
    q = Query().anchor("sales", "s").path_join(VerbHop("customer", "c", "c.id = s.customer_id")).group_by("c.name").agg(total="sum(s.revenue)")
    q = q.having(AggRef("total") > 3000).window(r="rank() OVER (ORDER BY total DESC)").qualify(WinRef("r") <= 1)
    assert [tuple(r) for r in q.to_df(spark, star).collect()] == [("Alice", 5200.0, 1)]


def test_duplicate_names_are_told_apart(spark, star):
    q = Query().anchor("sales", "s").path_join(VerbHop("customer", "c", "c.id = s.customer_id"))
    assert {"s_id", "c_id", "name"} <= set(q.to_df(spark, star).columns)


def test_exists_and_forall(spark, star):
    hop = VerbHopInverse("sales", "s", "s.customer_id = c.id")
    find = lambda p: sorted(r.name for r in Query().anchor("customer", "c").where(p).to_df(spark, star).collect())
    assert find(PathPred(hop, PropRef("s.revenue") > 3000)) == ["Alice", "Bob"]
    assert find(PathPred(hop, PropRef("s.revenue") > 500, "FORALL")) == ["Bob", "Carol"]
    assert find(~PathPred(hop, PropRef("s.revenue") > 3000) | (PropRef("c.name") == "Bob")) == ["Bob", "Carol"]


def test_bands_are_checked():
    with pytest.raises(SemanticError):
        Query().where(AggRef("x") > 1)
    with pytest.raises(SemanticError):
        Query().having(PropRef("a.b") > 1)
    with pytest.raises(SemanticError):
        Query().anchor("t", "t").having(AggRef("x") > 1).validate()
    with pytest.raises(SemanticError):
        Query().anchor("t", "t").qualify(WinRef("x") > 1).validate()


def test_literals_keep_their_dots():
    assert scoped("a.b = 'x.y' AND c.d > 1.5") == "a__b = 'x.y' AND c__d > 1.5"


def test_scd2_and_table(spark, tmp_path):
    schema = "nk string, v string, checksum string, is_current boolean, valid_from string, valid_to string"
    now = spark.createDataFrame([("a", "1", None, True, "2024-01-01", None)], schema).withColumn("checksum", row_hash(["v"]))
    t = VersionedTable(spark, f"file://{tmp_path}/dim")
    t.write(now)
    batch = spark.createDataFrame([("a", "2"), ("b", "1")], "nk string, v string")
    n = t.merge(batch, ["nk"], ["v"], "2024-02-01", change="batch-1")
    assert t.merge(batch, ["nk"], ["v"], "2024-03-01", change="batch-1") == n  # the same change is made once
    got = sorted((r.nk, r.v, r.is_current, r.valid_to) for r in t.read().collect())
    assert got == [("a", "1", False, "2024-02-01"), ("a", "2", True, None), ("b", "1", True, None)]
    assert t.read(1).count() == 1
    again = scd2(t.read(), batch, ["nk"], ["v"], "2024-04-01")
    assert again.count() == 3
    twice = spark.createDataFrame([("a", "3", 1), ("a", "4", 2)], "nk string, v string, o int")
    assert [r.v for r in deduplicated(twice, ["nk"], "o").collect()] == ["4"]
