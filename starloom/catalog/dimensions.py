"""Slowly changing dimensions, fact loaders and key resolution.

The base state is the customer table as of 1995; the batch has other segments for keys
divisible by 3, other balances for keys divisible by 5, and new keys from 10,000,000 on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import loaders, scd
from .common import CUST_HIST_SQL, Topic, cust_hist

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES
NK, AS_OF = ["c_custkey"], "2000-01-01"
TR = ["c_mktsegment", "c_nationkey"]


def _base(t, tracked=TR, **extra):
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    c = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return c.withColumns({k: v for k, v in extra.items()}).withColumns({"checksum": scd.row_hash(tracked), "is_current": F.lit(True), "valid_from": ts("1995-01-01"), "valid_to": ts(None)})


def _batch(t):
    c = t("customer")
    moved = c.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, F.lit(0)).otherwise(F.col("c_nationkey")).cast("int").alias("c_nationkey"))
    new = c.filter("c_custkey % 7 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), "c_nationkey")
    return moved.unionByName(new)


BATCH = """batch AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey
 FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, 'NEW', c_nationkey FROM customer WHERE c_custkey % 7 = 0)"""
_D = "TIMESTAMP '2000-01-01'"
_OUT = ["c_custkey", "c_mktsegment", "c_nationkey", "is_current", "valid_from", "valid_to"]


@T.query(f"""WITH {BATCH} SELECT c.c_custkey, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment, CAST(coalesce(b.c_nationkey, c.c_nationkey) AS INTEGER) AS c_nationkey, TIMESTAMP '1995-01-01' AS valid_from FROM customer c LEFT JOIN batch b USING (c_custkey)
UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS INTEGER), {_D} FROM batch WHERE c_custkey >= 10000000""")
def scd1(t):
    return scd.scd1(_base(t), _batch(t), NK, TR, AS_OF).select("c_custkey", "c_mktsegment", "c_nationkey", "valid_from")


_SCD2 = f"""WITH {BATCH}, ch AS (SELECT b.* FROM batch b JOIN customer c USING (c_custkey) WHERE b.c_mktsegment <> c.c_mktsegment OR b.c_nationkey <> c.c_nationkey)
SELECT c.c_custkey, c.c_mktsegment, c.c_nationkey, ch.c_custkey IS NULL AS is_current, TIMESTAMP '1995-01-01' AS valid_from, CASE WHEN ch.c_custkey IS NOT NULL THEN {_D} END AS valid_to FROM customer c LEFT JOIN ch USING (c_custkey)
UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS INTEGER), TRUE, {_D}, NULL FROM ch
UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS INTEGER), TRUE, {_D}, NULL FROM batch WHERE c_custkey >= 10000000"""


@T.query(_SCD2)
def scd2(t):
    return scd.scd2(_base(t), _batch(t), NK, TR, AS_OF).select(*_OUT)


@T.query(_SCD2)
def stream_dedup(t):
    """Every key twice in the batch; the later row counts."""
    b = _batch(t)
    twice = b.withColumn("seq", F.lit(2)).unionByName(b.withColumns({"c_mktsegment": F.lit("OLD"), "seq": F.lit(1)}))
    return scd.scd2(_base(t), twice, NK, TR, AS_OF, deduplicate_by="seq").select(*_OUT)


@T.query(f"""WITH {BATCH}, b0 AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_custkey % 4 = 0 AS inf FROM customer),
j AS (SELECT o.*, b.c_mktsegment AS s2, b.c_nationkey AS n2, b.c_custkey IS NOT NULL AS hit FROM b0 o LEFT JOIN batch b USING (c_custkey)),
k AS (SELECT *, hit AND inf AS re, hit AND NOT inf AND (s2 <> c_mktsegment OR n2 <> c_nationkey) AS ch FROM j)
SELECT c_custkey, CASE WHEN re THEN s2 ELSE c_mktsegment END AS c_mktsegment, CAST(CASE WHEN re THEN n2 ELSE c_nationkey END AS INTEGER) AS c_nationkey, inf AND NOT re AS is_inferred, NOT ch AS is_current FROM k
UNION ALL SELECT c_custkey, s2, CAST(n2 AS INTEGER), FALSE, TRUE FROM k WHERE ch
UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS INTEGER), FALSE, TRUE FROM batch WHERE c_custkey >= 10000000""")
def scd2_reconnect(t):
    gone = F.col("c_custkey") % 4 == 0
    base = _base(t).withColumns({"c_mktsegment": F.when(~gone, F.col("c_mktsegment")), "c_nationkey": F.when(~gone, F.col("c_nationkey")), "is_inferred": gone}).withColumn("checksum", scd.row_hash(TR))
    return scd.scd2(base, _batch(t), NK, TR, AS_OF, inferred="is_inferred").select("c_custkey", "c_mktsegment", "c_nationkey", "is_inferred", "is_current")


@T.query(f"""WITH {BATCH} SELECT c.c_custkey, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment, CASE WHEN b.c_mktsegment <> c.c_mktsegment THEN c.c_mktsegment END AS prev_segment FROM customer c LEFT JOIN batch b USING (c_custkey)
UNION ALL SELECT c_custkey, c_mktsegment, NULL FROM batch WHERE c_custkey >= 10000000""")
def scd3(t):
    base = _base(t, ["c_mktsegment"], prev_segment=F.lit(None).cast("string"))
    return scd.scd3(base, _batch(t), NK, [("c_mktsegment", "prev_segment")], AS_OF).select("c_custkey", "c_mktsegment", "prev_segment")


_MINI = f"""{BATCH}, mini0 AS (SELECT 1 AS id, 'BUILDING' AS c_mktsegment, 0 AS c_nationkey), miss AS (SELECT DISTINCT b.c_mktsegment, b.c_nationkey FROM batch b WHERE NOT EXISTS (SELECT 1 FROM mini0 m WHERE m.c_mktsegment = b.c_mktsegment AND m.c_nationkey = b.c_nationkey)),
mini AS (SELECT * FROM mini0 UNION ALL SELECT 1 + row_number() OVER (ORDER BY c_mktsegment, c_nationkey), c_mktsegment, c_nationkey FROM miss)"""


def _mini(t):
    spark = t("region").sparkSession
    mini = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(0).cast("int").alias("c_nationkey"))
    base = _base(t).select("c_custkey", F.lit(0).cast("bigint").alias("profile_sk"), F.lit(None).cast("bigint").alias("current_profile_sk"), "is_current", "valid_from", "valid_to").withColumn("checksum", scd.row_hash(["profile_sk"]))
    return mini, base


@T.query(f"""WITH {_MINI} SELECT CAST(id AS BIGINT) AS id, c_mktsegment, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM mini""")
def mini_dimension(t):
    return scd.upsert_profiles(_mini(t)[0], _batch(t), TR)


@T.query(f"""WITH {_MINI}, x AS (SELECT c_custkey, id FROM batch JOIN mini USING (c_mktsegment, c_nationkey))
SELECT c_custkey, CAST(0 AS BIGINT) AS profile_sk, x.id IS NULL AS is_current FROM customer LEFT JOIN x USING (c_custkey) UNION ALL SELECT c_custkey, CAST(id AS BIGINT), TRUE FROM x""")
def scd4(t):
    mini, base = _mini(t)
    return scd.scd4(mini, base.drop("current_profile_sk"), _batch(t), NK, TR, [], AS_OF)[1].select("c_custkey", "profile_sk", "is_current")


@T.query(f"""WITH {_MINI}, x AS (SELECT c_custkey, id FROM batch JOIN mini USING (c_mktsegment, c_nationkey))
SELECT c_custkey, CAST(0 AS BIGINT) AS profile_sk, CAST(coalesce(x.id, 0) AS BIGINT) AS current_profile_sk, x.id IS NULL AS is_current FROM customer LEFT JOIN x USING (c_custkey) UNION ALL SELECT c_custkey, CAST(id AS BIGINT), CAST(id AS BIGINT), TRUE FROM x""")
def scd5(t):
    mini, base = _mini(t)
    return scd.scd5(mini, base, _batch(t), NK, TR, [], AS_OF)[1].select("c_custkey", "profile_sk", "current_profile_sk", "is_current")


@T.query(f"""WITH {BATCH}, j AS (SELECT c.*, b.c_mktsegment AS s2, b.c_nationkey AS n2, b.c_custkey IS NOT NULL AND b.c_nationkey <> c.c_nationkey AS ver, b.c_custkey IS NOT NULL AND b.c_nationkey = c.c_nationkey AND b.c_mktsegment <> c.c_mktsegment AS ovr FROM customer c LEFT JOIN batch b USING (c_custkey))
SELECT c_custkey, CASE WHEN ovr THEN s2 ELSE c_mktsegment END AS c_mktsegment, c_nationkey, NOT ver AS is_current FROM j UNION ALL SELECT c_custkey, s2, CAST(n2 AS INTEGER), TRUE FROM j WHERE ver UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS INTEGER), TRUE FROM batch WHERE c_custkey >= 10000000""")
def scd6(t):
    return scd.scd6(_base(t), _batch(t), NK, ["c_mktsegment"], ["c_nationkey"], AS_OF).select("c_custkey", "c_mktsegment", "c_nationkey", "is_current")


@T.query(f"""WITH {BATCH}, o AS (SELECT c_custkey, '{{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}}' AS metadata FROM customer), b AS (SELECT c_custkey, '{{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}}' AS metadata FROM batch),
ch AS (SELECT b.c_custkey, b.metadata, o.metadata AS diff FROM b LEFT JOIN o USING (c_custkey) WHERE o.metadata IS NULL OR o.metadata <> b.metadata)
SELECT o.c_custkey, o.metadata, NULL AS metadata_diff, ch.c_custkey IS NULL AS is_current FROM o LEFT JOIN ch USING (c_custkey) UNION ALL SELECT c_custkey, metadata, diff, TRUE FROM ch""")
def scd_meta(t):
    base = scd.metadata_bag(t("customer"), NK, TR).withColumns({"metadata_diff": F.lit(None).cast("string"), "is_current": F.lit(True), "valid_from": F.lit("1995-01-01").cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    return scd.scd_metadata(base, _batch(t), NK, TR, AS_OF).select("c_custkey", "metadata", "metadata_diff", "is_current")


@T.query(f"""WITH {BATCH} SELECT c_custkey, concat_ws(',', CASE WHEN b.c_mktsegment <> c.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN b.c_nationkey <> c.c_nationkey THEN 'c_nationkey' END) AS changed FROM batch b JOIN customer c USING (c_custkey) WHERE b.c_mktsegment <> c.c_mktsegment OR b.c_nationkey <> c.c_nationkey""")
def scd_column_diff(t):
    return scd.changed_columns(t("customer"), _batch(t), NK, TR).select("c_custkey", F.array_join("changes.column", ",").alias("changed"))


_SNAP = "snap AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1, 2)"


def _snap(t):
    return t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))


@T.query(f"""WITH {_SNAP}, m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM snap WINDOW w AS (PARTITION BY user_id ORDER BY d)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY d) AS streak FROM m), g AS (SELECT user_id, streak, max(kind) AS kind, min(d) AS valid_from FROM s GROUP BY 1, 2)
SELECT user_id, kind, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY streak) AS valid_to, lead(valid_from) OVER (PARTITION BY user_id ORDER BY streak) IS NULL AS is_current FROM g""")
def scd2_backfill(t):
    return scd.backfill(_snap(t), ["user_id"], ["kind"], "d").select("user_id", "kind", "valid_from", "valid_to", "is_current")


@T.query(f"""WITH {_SNAP} SELECT user_id, string_agg(strftime(d, '%Y-%m-%d') || '=' || kind, ';' ORDER BY d) AS history FROM snap GROUP BY 1""")
def cumulative_backfill(t):
    return scd.cumulative_backfill(_snap(t), ["user_id"], "d", ["kind"]).select("user_id", F.array_join(F.transform("history", lambda h: F.concat(h["d"].cast("string"), F.lit("="), h["kind"])), ";").alias("history"))


@T.query("""SELECT c_custkey, c_acctbal, DATE '2024-01-31' AS snapshot_date FROM customer""")
def load_snapshot(t):
    return loaders.with_snapshot_date(t("customer").select("c_custkey", "c_acctbal"), "2024-01-31")


_ACC = """tgt AS (SELECT o_orderkey, o_orderdate AS placed, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS shipped FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT l_orderkey AS o_orderkey, CAST(NULL AS TIMESTAMP) AS placed, max(l_shipdate) AS shipped FROM lineitem WHERE l_orderkey % 5 < 3 GROUP BY 1)"""


def _acc(t):
    nt = F.lit(None).cast("timestamp_ntz")
    tgt = t("orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderdate").alias("placed"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("shipped"))
    b = t("lineitem").filter("l_orderkey % 5 < 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped")).withColumn("placed", nt)
    return tgt, b


@T.query(f"""WITH {_ACC} SELECT o_orderkey, coalesce(b.placed, t.placed) AS placed, coalesce(b.shipped, t.shipped) AS shipped FROM tgt t LEFT JOIN b USING (o_orderkey) UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)""")
def load_accumulating(t):
    return loaders.accumulate(*_acc(t), ["o_orderkey"], ["placed", "shipped"])


@T.query(f"""WITH {_ACC} SELECT o_orderkey, coalesce(t.placed, b.placed) AS placed, coalesce(t.shipped, b.shipped) AS shipped FROM tgt t LEFT JOIN b USING (o_orderkey) UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt)""")
def load_accumulating_first_wins(t):
    return loaders.accumulate(*_acc(t), ["o_orderkey"], ["placed", "shipped"], first_wins=True)


@T.query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), y AS (SELECT user_id, n FROM d WHERE d = DATE '2024-01-10'), t AS (SELECT user_id, n FROM d WHERE d = DATE '2024-01-11')
SELECT coalesce(t.user_id, y.user_id) AS user_id, concat_ws(';', CASE WHEN y.user_id IS NOT NULL THEN y.n || '@10' END, CASE WHEN t.user_id IS NOT NULL THEN t.n || '@11' END) AS history, t.user_id IS NOT NULL AS is_active, CASE WHEN t.user_id IS NULL THEN 1 ELSE 0 END AS years_since_last_active FROM y FULL JOIN t ON y.user_id = t.user_id""")
def load_cumulative(t):
    day = t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    empty = day.limit(0).select("user_id", F.array(F.struct("n", F.lit("").alias("period"))).alias("seasons"), F.lit(0).alias("years_since_last_active"))
    one = loaders.cumulate(empty, day.filter("d = DATE '2024-01-10'"), "user_id", ["n"], "10")
    two = loaders.cumulate(one, day.filter("d = DATE '2024-01-11'"), "user_id", ["n"], "11")
    return two.select("user_id", F.array_join(F.transform("seasons", lambda s: F.concat(s["n"].cast("string"), F.lit("@"), s["period"])), ";").alias("history"), "is_active", "years_since_last_active")


_MASK = """SELECT user_id, CAST(bit_or(CASE WHEN a BETWEEN 0 AND 31 THEN CAST(1 AS BIGINT) << (31 - a) ELSE 0 END) AS BIGINT) AS mask FROM (SELECT user_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS INTEGER) AS a FROM events) GROUP BY 1"""


def _mask(t):
    days = t("events").groupBy("user_id").agg(F.collect_set(F.to_date("ts").cast("string")).alias("dates"))
    return loaders.bitmask(days, "user_id", "dates", "2024-01-31")


@T.query(_MASK)
def load_bitmask(t):
    return _mask(t)


@T.query(f"""SELECT user_id, CAST(bit_count(mask >> 25) AS INTEGER) AS l7, CAST(bit_count(mask >> 4) AS INTEGER) AS l28 FROM ({_MASK})""")
def l7_l28(t):
    return _mask(t).select("user_id", loaders.active_days("mask", 7).alias("l7"), loaders.active_days("mask", 28).alias("l28"))


@T.query("""SELECT user_id, array_to_string(list_transform(range(0, 31), lambda i: CAST(CAST(coalesce(m[i], 0) AS BIGINT) AS VARCHAR)), ',') AS metric FROM (SELECT user_id, map_from_entries(list((o, v))) AS m FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS o, count(*) AS v FROM events GROUP BY 1, 2) WHERE o BETWEEN 0 AND 30 GROUP BY 1)""")
def load_array_metric(t):
    one = t("events").select("user_id", F.lit(1.0).alias("v"), "ts")
    return loaders.array_metric(one, "user_id", "v", "ts", "2024-01-01").select("user_id", F.array_join(F.transform("metric", lambda x: x.cast("bigint").cast("string")), ",").alias("metric"))


@T.query(f"""WITH {CUST_HIST_SQL} SELECT o_orderkey, h.c_custkey * 10 + CASE WHEN h.c_mktsegment = 'MOVED' THEN 2 ELSE 1 END AS customer_sk FROM orders LEFT JOIN cust_hist h ON h.c_custkey = o_custkey AND h.is_current""")
def sk_resolve(t):
    return loaders.resolve(t("orders"), _sk(t), [("o_custkey", "c_custkey")], "sk", "customer_sk").select("o_orderkey", "customer_sk")


def _sk(t):
    return cust_hist(t).withColumn("sk", F.col("c_custkey") * 10 + F.when(F.col("c_mktsegment") == "MOVED", 2).otherwise(1))


@T.query(f"""WITH {CUST_HIST_SQL} SELECT o_orderkey, h.c_custkey * 10 + CASE WHEN h.c_mktsegment = 'MOVED' THEN 2 ELSE 1 END AS customer_sk FROM orders LEFT JOIN cust_hist h ON h.c_custkey = o_custkey AND h.valid_from <= o_orderdate AND (h.valid_to IS NULL OR h.valid_to > o_orderdate)""")
def sk_resolve_asof(t):
    return loaders.resolve(t("orders"), _sk(t), [("o_custkey", "c_custkey")], "sk", "customer_sk", at="o_orderdate").select("o_orderkey", "customer_sk")


@T.query("""WITH d AS (SELECT c_custkey, c_custkey + 1 AS sk FROM customer WHERE c_custkey % 4 <> 1), m AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM d))
SELECT c_custkey, sk, FALSE AS is_inferred FROM d UNION ALL SELECT o_custkey, (SELECT max(sk) FROM d) + row_number() OVER (ORDER BY o_custkey), TRUE FROM m""")
def sk_infer_missing(t):
    d = t("customer").filter("c_custkey % 4 <> 1").select("c_custkey", (F.col("c_custkey") + 1).alias("sk"), F.lit(True).alias("is_current"), F.lit(False).alias("is_inferred"), F.lit("1995-01-01").cast("timestamp_ntz").alias("valid_from"))
    return loaders.infer_members(t("orders"), d, "o_custkey", "c_custkey", "sk", AS_OF).select("c_custkey", "sk", "is_inferred")


@T.query(f"""WITH {BATCH} SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM batch) UNION ALL SELECT c_custkey, c_mktsegment FROM batch""")
def upsert_last_wins(t):
    return loaders.upsert(t("customer").select("c_custkey", "c_mktsegment"), _batch(t), NK)


@T.query("""SELECT o_custkey AS subject_id, o_orderkey AS object_id, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def edge_project_direct(t):
    return loaders.edge_projection(t("orders").filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey", ["o_totalprice"])


@T.query("""WITH g AS (SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2) SELECT a.l_suppkey AS subject_id, b.l_suppkey AS object_id, CAST(sum(a.q + b.q) AS BIGINT) AS q FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def edge_project_selfjoin(t):
    return loaders.self_join_edges(t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q")), "l_suppkey", "l_orderkey", ["q"])
