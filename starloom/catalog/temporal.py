"""Interval relations of an order's shipments, and differences of two states of customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from .common import CUST_HIST_SQL, Topic, cust_hist

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES

#: The relations in SQL, of intervals a and b.
_SQL = {
    "before": "a.e < b.s", "after": "b.e < a.s", "meets": "a.e = b.s", "met_by": "b.e = a.s",
    "overlaps": "a.s < b.s AND a.e > b.s AND a.e < b.e", "overlapped_by": "b.s < a.s AND b.e > a.s AND b.e < a.e",
    "starts": "a.s = b.s AND a.e < b.e", "started_by": "a.s = b.s AND b.e < a.e",
    "during": "b.s < a.s AND a.e < b.e", "contains": "a.s < b.s AND b.e < a.e",
    "finishes": "a.e = b.e AND b.s < a.s", "finished_by": "a.e = b.e AND a.s < b.s", "equals": "a.s = b.s AND a.e = b.e",
}
_SHIP = "ship AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(floor(l_quantity) AS INTEGER) AS e FROM lineitem)"


def _allen(relation: str):
    def run(t):
        day = F.to_date("l_shipdate")
        ship = t("lineitem").select("l_orderkey", "l_linenumber", day.alias("s"), F.date_add(day, F.floor("l_quantity").cast("int")).alias("e"))
        pairs = temporal.related(ship, ship, relation, ["l_orderkey"], ("s", "e"), F.col("l.l_linenumber") != F.col("r.l_linenumber"))
        return pairs.select("l.l_orderkey", F.col("l.l_linenumber").alias("line"), F.col("r.l_linenumber").alias("other"))

    return run


for _r, _where in _SQL.items():
    T.query(f"WITH {_SHIP} SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS other FROM ship a JOIN ship b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND {_where}", name=f"allen_{_r}")(_allen(_r))


@T.query("SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000")
def concurrent_tolerance(t):
    e = t("events").select("user_id", "event_id", "ts")
    o = e.select(F.col("user_id").alias("u"), F.col("event_id").alias("other"), F.col("ts").alias("ts2"))
    return e.join(o, [F.col("user_id") == F.col("u"), F.col("event_id") < F.col("other"), temporal.concurrent(F.col("ts"), F.col("ts2"), 3600)]).select("event_id", "other")


def _state(t, at: str):
    when = F.lit(at).cast("timestamp_ntz")
    return cust_hist(t).filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def _edges(t, year: int):
    return t("orders").filter(F.year("o_orderdate") == year).select("o_custkey", "o_orderpriority").distinct()


def _edge_sql(new: int, old: int) -> str:
    return f"SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = {new} EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = {old}"


def _node_sql(new: int, old: int) -> str:
    return f"SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = {new} EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = {old}"


@T.query(_edge_sql(1997, 1996))
def delta_added_edges(t):
    return temporal.added(_edges(t, 1996), _edges(t, 1997), ["o_custkey", "o_orderpriority"])


@T.query(_edge_sql(1996, 1997))
def delta_removed_edges(t):
    return temporal.added(_edges(t, 1997), _edges(t, 1996), ["o_custkey", "o_orderpriority"])


@T.query(_node_sql(1997, 1996))
def delta_added_nodes(t):
    return temporal.added(_edges(t, 1996), _edges(t, 1997), ["o_custkey"]).select("o_custkey").distinct()


@T.query(_node_sql(1996, 1997))
def delta_removed_nodes(t):
    return temporal.added(_edges(t, 1997), _edges(t, 1996), ["o_custkey"]).select("o_custkey").distinct()


@T.query(f"""WITH {CUST_HIST_SQL}, o AS (SELECT * FROM cust_hist WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')), n AS (SELECT * FROM cust_hist WHERE valid_from <= TIMESTAMP '1999-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-01-01'))
SELECT c_custkey, o.c_mktsegment AS old_value, n.c_mktsegment AS new_value FROM o JOIN n USING (c_custkey) WHERE o.c_mktsegment IS DISTINCT FROM n.c_mktsegment""")
def delta_changed_property(t):
    return temporal.changed(_state(t, "1997-01-01"), _state(t, "1999-01-01"), ["c_custkey"], "c_mktsegment")
