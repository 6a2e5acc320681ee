"""Time windows, roles that change, grouping sets, shared parts of compositions, queries as SQL text, and loads of a star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..governance import lineage, migrations
from ..operators import graph, hierarchy, temporal, warehouse
from ..operators.algebra import QuestionAlgebra
from ..operators.expr import AggRef, PropRef, WinRef
from ..operators.paths import PathPred, VerbHop, VerbHopInverse
from ..operators.query import Query
from ..planning.dag import Compositions
from ..sources.table import VersionedTable
from .common import Topic

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES
P = PropRef

_ORDERED = "SELECT o_orderkey, {w} AS v FROM orders"
_BY = "PARTITION BY o_custkey"


def _windowed(window, fn="sum"):
    def run(t):
        q = Query().anchor("orders", "o").temporal_agg("v", fn, "o.o_totalprice", "o.o_orderdate", window, ("o.o_custkey",))
        return q.to_df(None, t).select("o_orderkey", F.round("v", 2).alias("v"))

    return run


for _n, _win, _sql in (
    ("temporal_ytd", temporal.YTD, f"sum(o_totalprice) OVER ({_BY}, date_trunc('year', o_orderdate) ORDER BY o_orderdate)"),
    ("temporal_qtd", temporal.QTD, f"sum(o_totalprice) OVER ({_BY}, date_trunc('quarter', o_orderdate) ORDER BY o_orderdate)"),
    ("temporal_mtd", temporal.MTD, f"sum(o_totalprice) OVER ({_BY}, date_trunc('month', o_orderdate) ORDER BY o_orderdate)"),
    ("temporal_rolling", temporal.rolling(90, "day"), f"sum(o_totalprice) OVER ({_BY} ORDER BY o_orderdate RANGE BETWEEN INTERVAL '7775999.999999 seconds' PRECEDING AND CURRENT ROW)"),
    ("temporal_trailing", temporal.trailing(3, "month"), f"sum(o_totalprice) OVER ({_BY} ORDER BY date_trunc('month', o_orderdate) RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING)"),
    ("temporal_period", temporal.period("1996-01-01", "1997-01-01"), f"sum(CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN o_totalprice END) OVER ({_BY})"),
):
    T.query(_ORDERED.format(w=f"round({_sql}, 2)"), name=_n)(_windowed(_win))


@T.query("""WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, CASE WHEN count(*) >= 3 THEN 'regular' ELSE 'casual' END AS role FROM orders GROUP BY 1, 2)
SELECT a.o_custkey FROM r a JOIN r b USING (o_custkey) WHERE a.y = 1996 AND a.role = 'casual' AND b.y = 1997 AND b.role = 'regular'""")
def delta_role_drift(t):
    def roles(year):
        n = t("orders").filter(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.count("*").alias("n"))
        return n.select("o_custkey", F.when(F.col("n") >= 3, "regular").otherwise("casual").alias("role"))

    return temporal.role_drift(roles(1996), roles(1997), ["o_custkey"], "role", "casual", "regular")


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {by}"


def _sets(how):
    def run(t):
        o = t("orders")
        grouped = getattr(o, how)("o_orderstatus", "o_orderpriority") if how != "sets" else o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], F.col("o_orderstatus"), F.col("o_orderpriority"))
        return grouped.agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("o_orderstatus", "o_orderpriority", "orders", "total")

    return run


for _n, _by in (("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    T.query(_SETS.format(by=_by), name=f"grouping_{_n}")(_sets(_n))


@T.query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 10")
def aggregate_band(t):
    q = Query().anchor("orders", "o").path_join(VerbHop("customer", "c", "c.c_custkey = o.o_custkey"))
    return q.aggregate(["c.c_mktsegment"], AggRef("n") > 10, n="count(*)", total="round(sum(o.o_totalprice), 2)").to_df(None, t)


@T.query("""WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), d AS (SELECT src, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 60)
SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT src FROM d)""")
def trim_join(t):
    """Rows whose edge stays when customers of few suppliers are trimmed."""
    lines = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    busy = graph.degree(lines, "out").filter("degree >= 60").select(F.col("id").alias("src"))
    q = Query().anchor("lineitem", "l").path_join(VerbHop("orders", "o", "o.o_orderkey = l.l_orderkey"), how="inner").trim("o.o_custkey", "l.l_suppkey", lines.join(busy, "src", "left_semi"))
    return q.to_df(None, t).select("o_orderkey", "l_linenumber")


@T.query("""SELECT c_mktsegment, c_nationkey, n, r FROM (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS r FROM (
SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_totalprice > 150000) GROUP BY 1, 2)) WHERE r <= 2""")
def query_as_sql(t):
    """A three-band query rendered as SQL and run from its text."""
    rich = PathPred([VerbHopInverse("orders", "o", "o.o_custkey = c.c_custkey")], P("o.o_totalprice") > 150000)
    q = Query().anchor("customer", "c").where(rich).group_by("c.c_mktsegment", "c.c_nationkey").agg(n="count(*)")
    q = q.window(r="cast(rank() OVER (PARTITION BY c.c_mktsegment ORDER BY count(*) DESC, c.c_nationkey) as bigint)").qualify(WinRef("r") <= 2)
    for name in ("customer", "orders"):
        t(name).createOrReplaceTempView(name)
    spark = t("customer").sparkSession
    return spark.sql(q.to_sql()).select("c_mktsegment", "c_nationkey", "n", "r")


@T.query("SELECT k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def algebra_as_sql(t):
    """A composition's chain of WITH parts, run from its text."""
    a, b = "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000"
    for name in ("customer", "orders"):
        t(name).createOrReplaceTempView(name)
    spark = t("customer").sparkSession
    q = QuestionAlgebra().add("rich", spark.sql(a), a).add("buys", spark.sql(b), b).add("unused", spark.sql(a), a).compose("rich", "intersect", "buys", "both")
    return spark.sql(q.to_sql("both"))


@T.query("SELECT DISTINCT * FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def composition_minimal(t):
    """Conditions on one base become one, a part that comes twice runs once."""
    c = Compositions()
    rich, poor = c.leaf("cust", "cust", "c_acctbal > 5000"), c.leaf("cust", "cust", "NOT (c_acctbal > 5000)")
    built = c.leaf("cust", "cust", "c_mktsegment = 'BUILDING'")
    keys, late = c.union(rich, c.intersect(poor, built), rich), c.leaf("late")
    tables = {"cust": t("customer"), "late": t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))}
    (found,) = c.run(tables, keys)
    return found.select("c_custkey").distinct().subtract(tables["late"])


_UNDER = "SELECT CAST(r_regionkey AS BIGINT) AS ancestor, round(sum(s_acctbal), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"


def _tree(how):
    def run(t):
        k = lambda c: F.col(c).cast("bigint")
        # nations are numbered from 100 on, regions from 0
        nodes = t("region").select(k("r_regionkey").alias("id"), F.lit(None).cast("bigint").alias("up"), F.concat(F.lit("/"), "r_regionkey", F.lit("/")).alias("path"))
        nodes = nodes.union(t("nation").select(k("n_nationkey") + 100, k("n_regionkey"), F.concat(F.lit("/"), "n_regionkey", F.lit("/"), k("n_nationkey") + 100, F.lit("/"))))
        form = {"adjacency": {"parent": "up"}, "path": {"path": "path"}, "closure": {"links": hierarchy.closure(nodes, "id", "path")}}[how]
        facts = t("supplier").select((k("s_nationkey") + 100).alias("node"), "s_acctbal")
        out = hierarchy.Tree(nodes, "id", **form).rollup(facts, "node", 0, F.sum("s_acctbal"))
        return out.select(F.col("ancestor").cast("bigint").alias("ancestor"), F.round("total", 2).alias("total"))

    return run


for _n in ("adjacency", "path", "closure"):
    T.query(_UNDER, name=f"tree_{_n}")(_tree(_n))


def _loaded(t, n: int):
    """A warehouse of customers and their orders, loaded in two batches; orders of customers yet unknown infer them."""
    spark = t("orders").sparkSession
    dim = warehouse.Entity("customer", "dimension", "upsert", ("code",))
    fact = warehouse.Entity("orders", "fact", None, (), (), (warehouse.Reference("o_custkey", "customer", "code", "id", "customer_sk"),))
    root = storage.shared_path(spark, "warehouse")
    w = warehouse.Warehouse([fact, dim], lambda name: VersionedTable(spark, f"{root}/{name}"))
    some = t("customer").filter("c_mktsegment <> 'BUILDING'").select((F.col("c_custkey") + 1).alias("id"), F.col("c_custkey").alias("code"), F.lit(True).alias("is_current"), F.lit(False).alias("is_inferred"), F.lit("1995-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    first = {"customer": some, "orders": o.filter("o_orderkey % 2 = 0")}
    for change, batch in (("a", first), ("b", {"orders": o.filter("o_orderkey % 2 = 1")}), ("a", first)):  # the last is a replay
        w.load(batch, "2000-01-01", change)
    return w.tables["orders"].read(), w.tables["customer"].read()


@T.query("""SELECT o_orderkey, c_mktsegment = 'BUILDING' AS inferred FROM orders JOIN customer ON c_custkey = o_custkey""")
def warehouse_load(t):
    facts, dim = _loaded(t, 2)
    return facts.join(dim, F.col("customer_sk") == F.col("id")).filter("code = o_custkey").select("o_orderkey", F.col("is_inferred").alias("inferred"))


@T.query("""SELECT * FROM (VALUES ('q.segment', 'customer.c_mktsegment'), ('q.total', 'orders.o_totalprice'), ('q.total', 'orders.o_orderstatus')) x(target, source)""")
def column_lineage(t):
    """The source columns of each column, from the analysed plan."""
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    df = j.select(F.upper("c_mktsegment").alias("segment"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("part")).groupBy("segment").agg(F.sum("part").alias("total"))
    edges = lineage.of_plan(df, "q")
    return t("orders").sparkSession.createDataFrame([(e.target, e.source) for e in edges], "target string, source string")


@T.query("""SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, 'new' AS tier, TRUE AS is_current, TIMESTAMP '2000-01-01' AS valid_from FROM customer""")
def migrated(t):
    """A table brought to its model: a column more, one less, one wider, and a history begun."""
    m = migrations.Model("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "tier": "string"}, ("c_custkey",), 2, {"tier": "new"})
    df = t("customer")
    steps = migrations.guard(migrations.difference(m, df.schema), allow_destructive=True)
    return migrations.applied(df, m, steps, "2000-01-01").select("c_custkey", "c_name", "c_nationkey", "tier", "is_current", "valid_from")


