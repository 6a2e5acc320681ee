"""Queries of the three-band builder (bands 1 to 3)."""

from __future__ import annotations

from ..operators.expr import AggRef, Arith, PropRef, WinRef
from ..operators.paths import Compose, PathAgg, PathPred, VerbHop, VerbHopInverse
from ..operators.query import Query, SemiAdditive
from .common import CUST_HIST_SQL, Topic, cust_hist

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES
P = PropRef


def _oc() -> Query:
    return Query().anchor("orders", "o").path_join(VerbHop("customer", "c", "c.c_custkey = o.o_custkey"))


@T.query("""SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000""")
def b1_filter(t):
    q = _oc().where(P("c.c_mktsegment") == "BUILDING").where(P("o.o_totalprice") > 200000)
    return q.to_df(None, t).select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@T.query("""SELECT c_mktsegment, c_nationkey, ROUND(CAST(SUM(o_totalprice) AS DOUBLE), 2) AS total, COUNT(*) AS cnt FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 HAVING COUNT(*) > 110""")
def b1_b2_having(t):
    return _oc().group_by("c.c_mktsegment", "c.c_nationkey").agg(total="round(sum(o.o_totalprice), 2)", cnt="count(*)").having(AggRef("cnt") > 110).to_df(None, t)


@T.query("""SELECT o_orderkey, o_custkey, rn FROM (SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders LEFT JOIN customer ON c_custkey = o_custkey) WHERE rn = 1""")
def b1_b3_qualify(t):
    q = _oc().window(rn="cast(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) as bigint)").qualify(WinRef("rn") == 1)
    return q.to_df(None, t).select("o_orderkey", "o_custkey", "rn")


@T.query("""SELECT * FROM (SELECT c_custkey, c_nationkey, ROUND(SUM(o_totalprice), 2) AS total_rev, COUNT(*) AS cnt, RANK() OVER (ORDER BY ROUND(SUM(o_totalprice), 2) DESC) AS rnk
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'FURNITURE' AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2 HAVING ROUND(SUM(o_totalprice), 2) > 500) WHERE rnk <= 10""")
def b1_b2_b3_full(t):
    """Customers of one segment ranked by revenue."""
    return (
        _oc().where((P("c.c_mktsegment") == "FURNITURE") & (P("o.o_orderdate") >= "1996-01-01"))
        .group_by("c.c_custkey", "c.c_nationkey").agg(total_rev="round(sum(o.o_totalprice), 2)", cnt="count(*)").having(AggRef("total_rev") > 500)
        .window(rnk="cast(rank() OVER (ORDER BY total_rev DESC) as bigint)").qualify(WinRef("rnk") <= 10).to_df(None, t)
    )


_LI = "l_orderkey, l_linenumber"


def _li(p):
    return Query().anchor("lineitem", "l").where(p)


@T.query(f"""SELECT {_LI} FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity < 5) AND NOT (l_discount > 0.05 AND l_linestatus = 'O')""")
def bool_tree(t):
    p = ((P("l.l_returnflag") == "R") | (P("l.l_quantity") < 5)) & ~((P("l.l_discount") > 0.05) & (P("l.l_linestatus") == "O"))
    return _li(p).to_df(None, t).select("l_orderkey", "l_linenumber")


@T.query(f"""SELECT {_LI} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag IN ('A', 'N') AND l_linestatus LIKE 'F%'""")
def raw_pred(t):
    return _li("l.l_shipdate >= TIMESTAMP_NTZ '1997-01-01'").where(P("l.l_returnflag").isin(["A", "N"])).where(P("l.l_linestatus").like("F%")).to_df(None, t).select("l_orderkey", "l_linenumber")


@T.query(f"""SELECT {_LI} FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 40000""")
def arith_expr(t):
    return _li(P("l.l_extendedprice") * Arith(1, "-", P("l.l_discount")) > 40000).to_df(None, t).select("l_orderkey", "l_linenumber")


@T.query("""SELECT c_custkey, o_orderkey IS NULL AS lonely FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 WHERE o_orderkey IS NULL OR c_acctbal IS NOT NULL AND c_acctbal > 9000""")
def is_null_pred(t):
    q = Query().anchor("customer", "c").path_join(VerbHopInverse("orders", "o", "o.o_custkey = c.c_custkey AND o.o_totalprice > 450000"))
    q = q.where(P("o.o_orderkey").is_null() | (P("c.c_acctbal").is_not_null() & (P("c.c_acctbal") > 9000)))
    return q.to_df(None, t).selectExpr("c_custkey", "o_orderkey IS NULL AS lonely")


_BIG = VerbHopInverse("orders", "o", "o.o_custkey = c.c_custkey")


@T.query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""")
def path_exists_1hop(t):
    return Query().anchor("customer", "c").where(PathPred(_BIG, P("o.o_totalprice") > 300000)).to_df(None, t).select("c_custkey")


_TWO = Compose(_BIG, VerbHopInverse("lineitem", "l", "l.l_orderkey = o.o_orderkey"))
_THREE = Compose(_TWO, VerbHop("part", "p", "p.p_partkey = l.l_partkey"))


@T.query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_custkey = c.c_custkey AND p.p_size = 7 AND l.l_quantity > 45)""")
def path_exists_2hop(t):
    return Query().anchor("customer", "c").where(PathPred(_THREE, (P("p.p_size") == 7) & (P("l.l_quantity") > 45))).to_df(None, t).select("c_custkey")


@T.query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def path_not_exists(t):
    return Query().anchor("customer", "c").where(~PathPred(_BIG, P("o.o_orderstatus") == "F")).to_df(None, t).select("c_custkey")


@T.query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND NOT (l.l_quantity <= 40))""")
def path_forall(t):
    return Query().anchor("orders", "o").where(PathPred(VerbHopInverse("lineitem", "l", "l.l_orderkey = o.o_orderkey"), P("l.l_quantity") <= 40, "FORALL")).to_df(None, t).select("o_orderkey")


@T.query("""SELECT c_custkey FROM customer c WHERE c.c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""")
def path_exists_or(t):
    return Query().anchor("customer", "c").where((P("c.c_acctbal") > 9000) | PathPred(_BIG, P("o.o_totalprice") > 400000)).to_df(None, t).select("c_custkey")


FKS = {("orders", "customer"): [("o_custkey", "c_custkey")], ("customer", "nation"): [("c_nationkey", "n_nationkey")], ("nation", "region"): [("n_regionkey", "r_regionkey")]}


@T.query("""SELECT r_name, COUNT(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def fk_inferred_join(t):
    q = Query().anchor("orders", "o").foreign_keys(FKS).join_model("orders", "customer", "o", "c").join_model("customer", "nation", "c", "n").join_model("nation", "region", "n", "r")
    return q.group_by("r.r_name").agg(n="count(*)").to_df(None, t)


@T.query(f"""WITH {CUST_HIST_SQL} SELECT c_mktsegment, COUNT(*) AS n FROM orders LEFT JOIN cust_hist h ON h.c_custkey = o_custkey AND h.is_current GROUP BY 1""")
def scd2_join_current(t):
    q = Query().anchor("orders", "o").join_dim(cust_hist(t), "o.o_custkey", "c_custkey", "h")
    return q.group_by("h.c_mktsegment").agg(n="count(*)").to_df(None, t)


@T.query(f"""WITH {CUST_HIST_SQL} SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS v FROM orders LEFT JOIN cust_hist h ON h.c_custkey = o_custkey AND h.valid_from <= TIMESTAMP '1997-06-01' AND (h.valid_to IS NULL OR h.valid_to > TIMESTAMP '1997-06-01') GROUP BY 1""")
def scd2_join_asof(t):
    q = Query().anchor("orders", "o").path_join(VerbHop(cust_hist(t), "h", "h.c_custkey = o.o_custkey")).as_of("TIMESTAMP_NTZ '1997-06-01'")
    return q.group_by("h.c_mktsegment").agg(n="count(*)", v="round(sum(o.o_totalprice), 2)").to_df(None, t)


@T.query(f"""WITH {CUST_HIST_SQL} SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN cust_hist h ON h.c_custkey = o_custkey AND h.valid_from <= o_orderdate AND (h.valid_to IS NULL OR h.valid_to > o_orderdate)""")
def pit_fact_join(t):
    return Query().anchor("orders", "o").join_dim(cust_hist(t), "o.o_custkey", "c_custkey", "h", at="o.o_orderdate").to_df(None, t).select("o_orderkey", "c_mktsegment")


@T.query("""SELECT r_name, p_type, COUNT(*) AS n FROM region CROSS JOIN (SELECT DISTINCT p_type FROM part) GROUP BY 1, 2""")
def cross_join(t):
    q = Query().anchor("region", "r").cross_join(t("part").select("p_type").distinct(), "p")
    return q.group_by("r.r_name", "p.p_type").agg(n="count(*)").to_df(None, t)


@T.query("""SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS sum_c_acctbal, ROUND(AVG(c_acctbal), 6) AS avg_c_acctbal, COUNT(*) AS count FROM customer GROUP BY 1""")
def sum_avg_count_sugar(t):
    d = Query().anchor("customer", "c").group_by("c.c_mktsegment").sum("c.c_acctbal").avg("c.c_acctbal").count().to_df(None, t)
    return d.selectExpr("c_mktsegment", "round(sum_c_acctbal, 2) AS sum_c_acctbal", "round(avg_c_acctbal, 6) AS avg_c_acctbal", "count")


@T.query("""SELECT o_orderpriority, COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS f_customers, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def count_distinct_case(t):
    return Query().anchor("orders", "o").group_by("o.o_orderpriority").agg(f_customers="count(DISTINCT CASE WHEN o.o_orderstatus = 'F' THEN o.o_custkey END)", customers="count(DISTINCT o.o_custkey)").to_df(None, t)


@T.query("""SELECT l_linestatus, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned, ROUND(SUM(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS q FROM lineitem GROUP BY 1""")
def filter_agg(t):
    return Query().anchor("lineitem", "l").group_by("l.l_linestatus").agg(returned="count(*) FILTER (WHERE l.l_returnflag = 'R')", q="round(sum(l.l_quantity) FILTER (WHERE l.l_discount > 0.05), 2)").to_df(None, t)


@T.query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS v FROM orders GROUP BY 1""")
def date_trunc_month(t):
    return Query().anchor("orders", "o").date_trunc_by("o.o_orderdate", "month", "month").agg(n="count(*)", v="round(sum(o.o_totalprice), 2)").to_df(None, t)


def _semi(t, fallback):
    rule = SemiAdditive("e.value", ("e.user_id",), fallback, "struct(e.ts, e.event_id)" if fallback == "last" else None)
    d = Query().anchor("events", "e").group_by("e.user_id").semi_additive("v", rule).to_df(None, t)
    return d.selectExpr("user_id", "round(v, 6) AS v")


@T.query("""SELECT user_id, ROUND(value, 6) AS v FROM (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def semi_additive_last(t):
    return _semi(t, "last")


@T.query("""SELECT user_id, ROUND(AVG(value), 6) AS v FROM events GROUP BY 1""")
def semi_additive_avg(t):
    return _semi(t, "avg")


@T.query("""SELECT user_id, ROUND(MAX(value), 6) AS v FROM events GROUP BY 1""")
def semi_additive_max(t):
    return _semi(t, "max")


@T.query("""SELECT c_custkey, COALESCE(n, 0) AS n_orders, COALESCE(v, 0.0) AS v FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def path_agg(t):
    ok = P("o.o_orderstatus") != "P"
    q = Query().anchor("customer", "c").path_agg(PathAgg(_BIG, "count(*)", "n_orders", ok, 0)).path_agg(PathAgg(_BIG, "round(sum(o.o_totalprice), 2)", "v", ok, 0.0))
    return q.to_df(None, t).select("c_custkey", "n_orders", "v")


@T.query("""SELECT n_regionkey, CAST(ROUND(EXP(SUM(LN(n_nationkey + 1)))) AS BIGINT) AS prod FROM nation GROUP BY 1""")
def product_agg(t):
    from pyspark.sql import functions as F

    return t("nation").groupBy("n_regionkey").agg(F.round(F.product(F.col("n_nationkey") + 1)).cast("bigint").alias("prod"))


def _ord(**w):
    return Query().anchor("orders", "o").window(**w)


def _win(sql, name, **w):
    cols = ["o_orderkey", *w]

    @T.query(sql, name)
    def f(t):
        return _ord(**{k: v for k, v in w.items()}).to_df(None, t).select(*cols)

    f.__name__ = name


_BY = "PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey"
_DBY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_win(f"SELECT o_orderkey, LAG(o_totalprice) OVER ({_DBY}) AS before, LEAD(o_totalprice, 2) OVER ({_DBY}) AS later FROM orders", "lag_lead", before=f"lag(o.o_totalprice) OVER ({_BY})", later=f"lead(o.o_totalprice, 2) OVER ({_BY})")
_win("SELECT o_orderkey, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders", "dense_rank", dr="cast(dense_rank() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderpriority) as bigint)")
_win("SELECT o_orderkey, ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate), 9) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate), 9) AS cd FROM orders", "percent_rank_cume_dist", pr="round(percent_rank() OVER (PARTITION BY o.o_orderstatus ORDER BY o.o_orderdate), 9)", cd="round(cume_dist() OVER (PARTITION BY o.o_orderstatus ORDER BY o.o_orderdate), 9)")
_win(f"SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER ({_DBY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run FROM orders", "running_sum", run=f"round(sum(o.o_totalprice) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)")
_win(f"SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER ({_DBY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m3, COUNT(*) OVER ({_DBY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders", "moving_window", m3=f"round(avg(o.o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)", before=f"count(*) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


@T.query("""SELECT c_custkey, NTILE(10) OVER (ORDER BY c_acctbal, c_custkey) AS decile FROM customer""")
def ntile_decile(t):
    d = Query().anchor("customer", "c").ntile_bucket("c.c_acctbal, c.c_custkey", 10, "decile").to_df(None, t)
    return d.selectExpr("c_custkey", "cast(decile as bigint) AS decile")


@T.query("""SELECT p_partkey, CAST((CASE WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice >= 1300 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice >= 1600 THEN 1 ELSE 0 END) AS BIGINT) AS bucket FROM part""")
def width_bucket_price(t):
    return Query().anchor("part", "p").width_bucket("p.p_retailprice", [1000, 1300, 1600], "bucket").to_df(None, t).select("p_partkey", "bucket")


@T.query("""SELECT p_brand, ROUND(quantile_cont(p_retailprice, 0.5), 6) AS med, quantile_disc(p_retailprice, 0.9) AS p90 FROM part GROUP BY 1""")
def percentile_cont_disc(t):
    return Query().anchor("part", "p").group_by("p.p_brand").agg(med="round(percentile_cont(0.5) WITHIN GROUP (ORDER BY p.p_retailprice), 6)", p90="percentile_disc(0.9) WITHIN GROUP (ORDER BY p.p_retailprice)").to_df(None, t)


@T.query("""SELECT user_day, n, SUM(n) OVER (ORDER BY user_day) AS total FROM (SELECT CAST(ts AS DATE) AS user_day, COUNT(DISTINCT user_id) AS n FROM events GROUP BY 1)""".replace("SUM(n) OVER (ORDER BY user_day)", "CAST(SUM(n) OVER (ORDER BY user_day) AS BIGINT)"))
def window_over_aggregate(t):
    q = Query().anchor("events", "e").column(user_day="cast(e.ts as date)").group_by("user_day").agg(n="count(DISTINCT e.user_id)")
    return q.window(total="sum(n) OVER (ORDER BY user_day)").to_df(None, t)


@T.query("""SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 3""")
def order_limit_distinct(t):
    return Query().anchor("customer", "c").to_df(None, t).select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(3)


@T.query("""SELECT n_name, ROUND(AVG(c_acctbal), 6) AS avg_c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def dimensional_inner(t):
    q = Query().anchor("customer", "c").foreign_keys(FKS).join_model("customer", "nation", "c", "n", how="inner").where(P("c.c_mktsegment") == "BUILDING").group_by("n.n_name").avg("c.c_acctbal")
    return q.to_df(None, t).selectExpr("n_name", "round(avg_c_acctbal, 6) AS avg_c_acctbal")
