"""A tree of regions, nations and customers; calendar, time and junk dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy
from .common import Topic

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES

_TREE = "tree AS (SELECT c_custkey, 'r' || n_regionkey AS r, 'n' || n_nationkey AS n, 'c' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _tree(t):
    """Customers with their path; regions and nations are the upper levels."""
    mark = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", mark("c", "c_custkey").alias("node"), hierarchy.build_path(mark("r", "n_regionkey"), mark("n", "n_nationkey"), mark("c", "c_custkey")).alias("path"))


@T.query(f"WITH {_TREE} SELECT r AS ancestor, c AS descendant, CAST(2 AS BIGINT) AS depth FROM tree UNION ALL SELECT n, c, 1 FROM tree UNION ALL SELECT c, c, 0 FROM tree")
def closure_build(t):
    return hierarchy.closure(_tree(t), "node", "path")


@T.query(f"WITH {_TREE} SELECT r AS ancestor, c AS descendant FROM tree UNION ALL SELECT n, c FROM tree")
def hier_ancestors_path(t):
    """Ancestors of all customers."""
    return hierarchy.closure(_tree(t), "node", "path").filter("depth > 0").select("ancestor", "descendant")


@T.query(f"WITH {_TREE} SELECT c AS descendant FROM tree WHERE r = 'r1'")
def hier_descendants_path(t):
    """Customers below region 1."""
    return hierarchy.closure(_tree(t), "node", "path").filter("ancestor = 'r1' and depth > 0").select("descendant")


def _rollup(t, level):
    tree = _tree(t).select(F.col("c_custkey").alias("key"), "path")
    return hierarchy.rollup(t("orders").select("o_custkey", "o_totalprice"), tree, "o_custkey", "key", "path", level, F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).select("ancestor", F.col("total").cast("double").alias("total"))


def _rollup_sql(level):
    return f"WITH {_TREE} SELECT {level} AS ancestor, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN tree ON o_custkey = c_custkey GROUP BY 1"


@T.query(_rollup_sql("r"))
def hier_rollup_path_region(t):
    return _rollup(t, 0)


@T.query(_rollup_sql("n"))
def hier_rollup_path_nation(t):
    return _rollup(t, 1)


def _nodes(t):
    """The tree as (node, parent)."""
    mark = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    r = t("region").select(mark("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = t("nation").select(mark("n", "n_nationkey"), mark("r", "n_regionkey"))
    return r.union(n).union(t("customer").select(mark("c", "c_custkey"), mark("n", "c_nationkey")))


_ADJACENT = """nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
links AS (SELECT node AS ancestor, node AS descendant, CAST(0 AS BIGINT) AS depth FROM nodes UNION ALL SELECT parent, descendant, depth + 1 FROM links JOIN nodes ON node = ancestor WHERE parent IS NOT NULL)"""


@T.query(f"WITH RECURSIVE {_ADJACENT} SELECT * FROM links")
def closure_build_adjacency(t):
    return hierarchy.adjacency_closure(_nodes(t), "node", "parent")


@T.query(f"WITH RECURSIVE {_ADJACENT} SELECT ancestor, depth FROM links WHERE descendant = 'c7' AND depth > 0")
def hier_ancestors_adjacency(t):
    return hierarchy.adjacency_closure(_nodes(t), "node", "parent").filter("descendant = 'c7' and depth > 0").select("ancestor", "depth")


@T.query(f"WITH RECURSIVE {_ADJACENT} SELECT descendant, depth FROM links WHERE ancestor = 'r1' AND depth > 0")
def hier_descendants_adjacency(t):
    return hierarchy.adjacency_closure(_nodes(t), "node", "parent").filter("ancestor = 'r1' and depth > 0").select("descendant", "depth")


@T.query(f"WITH RECURSIVE {_ADJACENT} SELECT ancestor, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM links JOIN orders ON descendant = 'c' || o_custkey WHERE ancestor LIKE 'n%' GROUP BY 1")
def hier_rollup_adjacency(t):
    facts = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("who"), "o_totalprice")
    nodes = _nodes(t).filter("node like 'n%'").select(F.col("node").alias("ancestor"))
    out = hierarchy.closure_rollup(facts, hierarchy.adjacency_closure(_nodes(t), "node", "parent"), "who", nodes, F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    return out.select("ancestor", F.col("total").cast("double").alias("total"))


@T.query("""SELECT CAST(d AS DATE) AS date_value, year(d) AS year, quarter(d) AS quarter, month(d) AS month, week(d) AS week_of_year, isodow(d) - 1 AS day_of_week, day(d) AS day_of_month,
monthname(d) AS month_name, dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) x(d)""")
def date_dim(t):
    return hierarchy.date_dimension(t("region").sparkSession, "1995-01-01", "2001-12-31")


@T.query("SELECT m AS minute_of_day, m // 60 AS hour, m % 60 AS minute, CASE WHEN m // 60 >= 21 THEN 'night' WHEN m // 60 >= 17 THEN 'evening' WHEN m // 60 >= 12 THEN 'afternoon' WHEN m // 60 >= 5 THEN 'morning' ELSE 'night' END AS time_of_day FROM range(1440) x(m)")
def time_dim(t):
    return hierarchy.time_dimension(t("region").sparkSession, [("morning", 5), ("afternoon", 12), ("evening", 17), ("night", 21)])


@T.query("SELECT a AS gift, b AS channel FROM (VALUES (TRUE), (FALSE)) x(a), (VALUES ('web'), ('store'), ('phone')) y(b)")
def junk_dim(t):
    return hierarchy.junk_dimension(t("region").sparkSession, {"gift": [True, False], "channel": ["web", "store", "phone"]})
