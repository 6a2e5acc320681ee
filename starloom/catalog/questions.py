"""Question algebra, temporal properties of users' events, and contract rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, sequences
from ..operators.algebra import QuestionAlgebra
from .common import CUST_HIST_SQL, Topic, cust_hist

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES

_RICH, _BUYS = "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000"


def _two(t):
    rich = t("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return QuestionAlgebra().add("rich", rich).add("buys", t("orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k")))


for _op, _sql in (("union", f"{_RICH} UNION ALL {_BUYS}"), ("intersect", f"{_RICH} INTERSECT {_BUYS}"), ("except", f"{_RICH} EXCEPT {_BUYS}"), ("with", _BUYS)):
    T.query(_sql, name=f"alg_{_op}")(lambda t, op=_op: _two(t).compose("rich", op, "buys", "out")["out"])


@T.query(f"SELECT l.k, r.k AS r_k FROM ({_RICH}) l JOIN ({_BUYS}) r ON l.k = r.k")
def alg_join(t):
    return _two(t).compose("rich", "join", "buys", "out", "l.k = r.k")["out"]


@T.query(f"({_RICH} INTERSECT {_BUYS}) UNION ALL ({_RICH} EXCEPT {_BUYS})")
def alg_cse(t):
    q = _two(t).compose("rich", "intersect", "buys", "both").compose("rich", "except", "buys", "only")
    return q.compose("both", "union", "only", "out")["out"]


_AT = lambda: F.struct("ts", "event_id")
_ROW = "e AS (SELECT user_id, event_type AS s, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_s = lambda *v: F.col("event_type").isin(*v)


def _property(name, sql, column):
    def run(t):
        return t("events").groupBy("user_id").agg(column().alias("holds"))

    T.query(f"WITH {_ROW} SELECT user_id, {sql} AS holds FROM (SELECT DISTINCT user_id FROM e) u", name=name)(run)


def _some(where, e="e"):
    return f"EXISTS (SELECT 1 FROM e {e} WHERE {e}.user_id = u.user_id AND {where})"


_property("ctl_eventually", _some("s = 'purchase' AND value > 150"), lambda: sequences.eventually(_s("purchase") & (F.col("value") > 150)))
_property("ctl_once", _some("s = 'error' AND value > 180"), lambda: sequences.eventually(_s("error") & (F.col("value") > 180)))
_property("ctl_globally", "NOT " + _some("value > 400"), lambda: sequences.globally(F.col("value") <= 400))
_property("ctl_until", f"EXISTS (SELECT 1 FROM e p WHERE p.user_id = u.user_id AND p.s = 'purchase' AND NOT EXISTS (SELECT 1 FROM e q WHERE q.user_id = p.user_id AND q.i < p.i AND q.s = 'error'))", lambda: sequences.until(~_s("error"), _s("purchase"), _AT()))
_property("ctl_since", f"EXISTS (SELECT 1 FROM e p WHERE p.user_id = u.user_id AND p.s = 'purchase' AND NOT EXISTS (SELECT 1 FROM e q WHERE q.user_id = p.user_id AND q.i > p.i AND q.s = 'error'))", lambda: sequences.since(~_s("error"), _s("purchase"), _AT()))
_property("safety", "NOT " + _some("s = 'error' AND value > 190"), lambda: sequences.safety(_s("error") & (F.col("value") > 190)))
_property("liveness", _some("s = 'signup'"), lambda: sequences.eventually(_s("signup")))
_property("response", "NOT EXISTS (SELECT 1 FROM e p WHERE p.user_id = u.user_id AND p.s = 'error' AND NOT EXISTS (SELECT 1 FROM e q WHERE q.user_id = p.user_id AND q.i >= p.i AND q.s IN ('view', 'click')))", lambda: sequences.response(_s("error"), _s("view", "click"), _AT()))
_property("persistence", _some("i = n AND s <> 'error'"), lambda: sequences.persistence(~_s("error"), _AT()))
_property("recurrence", "(SELECT count(DISTINCT CASE WHEN s <> 'error' THEN CAST(ts AS DATE) END) = max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 FROM e WHERE e.user_id = u.user_id)", lambda: sequences.recurrence(~_s("error"), F.unix_date(F.to_date("ts"))))


@T.query(f"WITH {_ROW} SELECT user_id, {_some('i = 2 AND s = ' + chr(39) + 'view' + chr(39))} AS holds FROM (SELECT DISTINCT user_id FROM e) u")
def ctl_next(t):
    return sequences.beside(t("events"), "user_id", _s("view"), _AT())


@T.query(f"WITH {_ROW} SELECT user_id, {_some('i = n - 1 AND s = ' + chr(39) + 'view' + chr(39))} AS holds FROM (SELECT DISTINCT user_id FROM e) u")
def ctl_previously(t):
    return sequences.beside(t("events"), "user_id", _s("view"), _AT(), back=True)


#: Events with faults: nulls, repeated ids, values out of range.
_DIRTY = "dirty AS (SELECT CASE WHEN event_id % 10 = 0 THEN event_id // 20 ELSE event_id END AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value, ts FROM events)"


def _dirty(t):
    i = F.col("event_id")
    return t("events").select(F.when(i % 10 == 0, F.floor(i / 20)).otherwise(i).alias("id"), F.when(i % 7 != 0, F.col("user_id")).alias("user_id"), "event_type", "value", "ts")


def _broken(t):
    """Histories with faults: some closed rows are current, some keys lack a current row, some periods have gaps."""
    k = F.col("c_custkey")
    h = cust_hist(t).filter((k % 6 != 0) | (F.col("c_mktsegment") != "MOVED"))
    end = F.when((k % 9 == 0) & F.col("valid_to").isNotNull(), F.lit("1997-06-01").cast("timestamp_ntz")).otherwise(F.col("valid_to"))
    return h.withColumn("valid_to", end).withColumn("is_current", F.col("is_current") | (k % 15 == 3)).withColumn("sum", F.when(k % 5 == 0, "x").otherwise(F.md5(F.concat_ws("|", "c_name", "c_mktsegment"))))


_BROKEN = f"""{CUST_HIST_SQL}, broken AS (SELECT c_custkey, c_name, c_mktsegment, valid_from, CASE WHEN c_custkey % 9 = 0 AND valid_to IS NOT NULL THEN TIMESTAMP '1997-06-01' ELSE valid_to END AS valid_to,
 is_current OR c_custkey % 15 = 3 AS is_current, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE md5(c_name || '|' || c_mktsegment) END AS sum FROM cust_hist WHERE c_custkey % 6 <> 0 OR c_mktsegment <> 'MOVED')"""


def _rule(name, table, severity, detail, rule, sql):
    base, make = (_DIRTY, _dirty) if table == "dirty" else (_BROKEN, _broken)
    row = f"SELECT '{name.upper()}' AS rule, '{severity}' AS severity, CAST(n AS BIGINT) AS violations, '{detail}' AS detail FROM ({sql}) WHERE n > 0"
    T.query(f"WITH {base} {row}", name=f"rule_{name}")(lambda t: contracts.report(make(t), [rule()]))
    return row, rule


_D = [
    _rule("not_null", "dirty", "error", "column=user_id", lambda: contracts.not_null("user_id"), "SELECT count(*) AS n FROM dirty WHERE user_id IS NULL"),
    _rule("no_duplicates", "dirty", "error", "column=id", lambda: contracts.no_duplicates("id"), "SELECT count(*) - count(DISTINCT id) AS n FROM dirty"),
    _rule("null_rate", "dirty", "warning", "column=user_id, max_pct=0.1", lambda: contracts.null_rate("user_id", 0.1), "SELECT count(*) - count(user_id) AS n FROM dirty HAVING count(user_id) < 0.9 * count(*)"),
    _rule("row_count", "dirty", "error", "min=100000000, max=None", lambda: contracts.row_count(100_000_000), "SELECT count(*) AS n FROM dirty"),
    _rule("value_range", "dirty", "error", "column=value, min=10, max=200", lambda: contracts.value_range("value", 10, 200), "SELECT count(*) AS n FROM dirty WHERE NOT value BETWEEN 10 AND 200"),
    _rule("regex_match", "dirty", "warning", "column=event_type, pattern=^[c-p]", lambda: contracts.regex_match("event_type", "^[c-p]"), "SELECT count(*) AS n FROM dirty WHERE event_type < 'c' OR event_type >= 'q'"),
    _rule("freshness", "dirty", "warning", "column=ts, hours=24", lambda: contracts.freshness("ts", 24, "2024-03-01"), "SELECT 1 AS n FROM dirty HAVING max(ts) < TIMESTAMP '2024-02-29'"),
    _rule("row_count_delta", "dirty", "warning", "previous=10, max_pct=0.5", lambda: contracts.row_count_delta(10, 0.5), "SELECT count(*) - 10 AS n FROM dirty"),
]
_rule("scd2_invariants", "broken", "error", "key=c_custkey", lambda: contracts.scd2_invariants("c_custkey"), """SELECT (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM broken WHERE is_current GROUP BY c_custkey))
 + (SELECT count(*) FROM broken WHERE is_current AND valid_to IS NOT NULL) + (SELECT count(*) FROM broken WHERE is_current AND valid_from IS NULL) + (SELECT count(*) FROM broken WHERE NOT is_current AND (valid_to IS NULL OR valid_from >= valid_to)) AS n""")
_rule("no_orphan_versions", "broken", "error", "key=c_custkey", lambda: contracts.no_orphan_versions("c_custkey"), "SELECT count(DISTINCT c_custkey) AS n FROM broken WHERE c_custkey NOT IN (SELECT c_custkey FROM broken WHERE is_current)")
_rule("monotonic_valid_from", "broken", "error", "key=c_custkey", lambda: contracts.monotonic_valid_from("c_custkey"), "SELECT count(DISTINCT h.c_custkey) AS n FROM broken h JOIN broken c ON h.c_custkey = c.c_custkey WHERE c.is_current AND NOT h.is_current AND h.valid_from > c.valid_from")
_rule("no_gap_periods", "broken", "warning", "key=c_custkey", lambda: contracts.no_gap_periods("c_custkey"), "SELECT count(*) AS n FROM (SELECT valid_to, lead(valid_from) OVER (PARTITION BY c_custkey ORDER BY valid_from) AS f FROM broken) WHERE valid_to <> f")
_rule("hash_consistency", "broken", "warning", "column=sum", lambda: contracts.hash_consistency("sum", ["c_name", "c_mktsegment"]), "SELECT count(*) AS n FROM broken WHERE sum = 'x'")


@T.query(f"WITH {_DIRTY} " + " UNION ALL ".join(f"({r})" for r, _ in _D))
def contract_report(t):
    return contracts.report(_dirty(t), [rule() for _, rule in _D])
