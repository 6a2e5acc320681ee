"""Gold tables, reports on drift, transforms, change logs and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns, transforms
from ..plans import observatory, retail
from ..sources import readers
from ..streaming import apply as streams
from .common import Topic

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES

_O = "o AS (SELECT o_orderkey AS k, o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount FROM orders), f AS (SELECT customer, min(day) AS first FROM o GROUP BY 1)"
_D = "d AS (SELECT DISTINCT user_id AS user, CAST(ts AS DATE) AS day FROM events)"


def _orders(t):
    return t("orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))


def _daily(t):
    return t("events").select(F.col("user_id").alias("user"), F.to_date("ts").alias("day")).distinct()


@T.query(f"""WITH {_O} SELECT day, c_mktsegment AS segment, count(*) AS orders, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT CASE WHEN first = day THEN customer END) AS new_customers,
 count(DISTINCT CASE WHEN first < day THEN customer END) AS returning_customers FROM o JOIN f USING (customer) JOIN customer ON c_custkey = customer GROUP BY 1, 2""")
def daily_sales(t):
    return retail.daily_sales(_orders(t), t("customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment")))


@T.query(f"""WITH {_O}, a AS (SELECT customer, first, (SELECT min(day) FROM o WHERE o.customer = f.customer AND day > first) AS again FROM f)
SELECT CAST(date_trunc('week', first) AS DATE) AS cohort, count(*) AS size, {', '.join(f"count(*) FILTER (again <= first + {d}) AS day_{d}" for d in (1, 7, 30))} FROM a GROUP BY 1""")
def cohort_retention(t):
    return retail.cohort_retention(_orders(t))


@T.query(f"""WITH {_D}, spine AS (SELECT user, first_day, CAST(unnest(range(CAST(first_day AS TIMESTAMP), (SELECT max(day) FROM d) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT user, min(day) AS first_day FROM d GROUP BY 1)),
 a AS (SELECT s.*, d.day IS NOT NULL AS active, max(d.day) OVER (PARTITION BY s.user ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spine s LEFT JOIN d ON d.user = s.user AND d.day = s.day)
SELECT user, first_day, day, CASE WHEN active AND before IS NULL THEN 'New' WHEN active AND before = day - 1 THEN 'Retained' WHEN active THEN 'Resurrected' WHEN before = day - 1 THEN 'Churned' ELSE 'Stale' END AS state FROM a""")
def growth_accounting(t):
    return retail.growth_accounting(_daily(t))


@T.query(f"WITH {_D}, n AS (SELECT day, count(*) AS active FROM d GROUP BY 1) SELECT day, active, CAST(sum(active) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling, CAST(sum(active) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS BIGINT) AS before FROM n")
def rolling_wau(t):
    return retail.rolling_active(_daily(t))


_STEPS = ["signup", "view", "purchase"]


@T.query(" UNION ALL ".join(f"SELECT '{s}' AS step, count(*) AS users FROM (SELECT user_id FROM events WHERE event_type IN ({', '.join(repr(x) for x in _STEPS[: i + 1])}) AND value > 100 GROUP BY 1 HAVING count(DISTINCT event_type) = {i + 1})" for i, s in enumerate(_STEPS)))
def funnel(t):
    return retail.funnel(t("events").filter("value > 100"), "user_id", "event_type", _STEPS)


@T.query("SELECT c_mktsegment AS segment, count(*) AS customers, count(*) FILTER (n > 1) / count(*) AS retained FROM (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def retention_by_segment(t):
    days = _orders(t).groupBy("customer").agg(F.count_distinct("day").alias("n"))
    who = t("customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    return days.join(who, "customer").groupBy("segment").agg(F.count("*").alias("customers"), (F.count(F.when(F.col("n") > 1, 1)) / F.count("*")).alias("retained"))


# the observatory: datasets are users of events, changes and checks are made of events
_OBS = """datasets AS (SELECT DISTINCT user_id AS dataset_id, 'd' || user_id AS dataset_name, CASE user_id % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS layer FROM events),
kinds AS (SELECT * FROM (VALUES (0, 'added', 'safe', FALSE, FALSE), (1, 'widened', 'additive', TRUE, FALSE), (2, 'type_changed', 'breaking', TRUE, TRUE), (3, 'removed', 'breaking', FALSE, TRUE)) x(evo_type_id, change_type, tier, requires_migration, requires_backfill)),
rules AS (SELECT * FROM (VALUES (0, 'NOT_NULL', 'error'), (1, 'NULL_RATE', 'warning'), (2, 'VALUE_RANGE', 'error')) x(rule_id, rule_name, severity)),
changes AS (SELECT user_id AS dataset_id, CAST(event_id % 4 AS INTEGER) AS evo_type_id, 'c' || event_id % 9 AS column_name, ts AS detected_at FROM events WHERE event_type = 'view'),
checks AS (SELECT user_id AS dataset_id, CAST(event_id % 3 AS INTEGER) AS rule_id, event_id % 50 AS violation_count, ts AS checked_at FROM events WHERE event_type <> 'view')"""


def _obs(t):
    e, s = t("events"), t("events").sparkSession
    u, i = F.col("user_id"), F.col("event_id")
    datasets = e.select(u.alias("dataset_id")).distinct().select("dataset_id", F.concat(F.lit("d"), "dataset_id").alias("dataset_name"), F.when(F.col("dataset_id") % 3 == 0, "bronze").when(F.col("dataset_id") % 3 == 1, "silver").otherwise("gold").alias("layer"))
    kinds = s.createDataFrame([(0, "added", "safe", False, False), (1, "widened", "additive", True, False), (2, "type_changed", "breaking", True, True), (3, "removed", "breaking", False, True)], "evo_type_id int, change_type string, tier string, requires_migration boolean, requires_backfill boolean")
    rules = s.createDataFrame([(0, "NOT_NULL", "error"), (1, "NULL_RATE", "warning"), (2, "VALUE_RANGE", "error")], "rule_id int, rule_name string, severity string")
    view = F.col("event_type") == "view"
    changes = e.filter(view).select(u.alias("dataset_id"), (i % 4).cast("int").alias("evo_type_id"), F.concat(F.lit("c"), i % 9).alias("column_name"), F.col("ts").alias("detected_at"))
    checks = e.filter(~view).select(u.alias("dataset_id"), (i % 3).cast("int").alias("rule_id"), (i % 50).alias("violation_count"), F.col("ts").alias("checked_at"))
    return datasets, kinds, rules, changes, checks


@T.query(f"WITH {_OBS} SELECT dataset_name, layer, count(*) AS total_changes, count(*) FILTER (tier = 'breaking') AS breaking_changes, round(CAST(100 AS DOUBLE) * count(*) FILTER (tier = 'breaking') / count(*), 1) AS breaking_pct FROM changes JOIN datasets USING (dataset_id) JOIN kinds USING (evo_type_id) GROUP BY 1, 2")
def breaking_change_rate(t):
    d, k, _, c, _ = _obs(t)
    return observatory.breaking_change_rate(c, d, k)


@T.query(f"WITH {_OBS} SELECT dataset_name, layer, CAST(sum(violation_count) AS BIGINT) AS total_violations, count(DISTINCT rule_id) AS distinct_rules, max(checked_at) AS latest_check FROM checks JOIN datasets USING (dataset_id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def worst_quality(t):
    d, _, _, _, q = _obs(t)
    return observatory.worst_quality(q, d)


@T.query(f"WITH {_OBS} SELECT date_trunc('day', detected_at) AS period, tier AS change_tier, count(*) AS event_count FROM changes JOIN kinds USING (evo_type_id) GROUP BY 1, 2")
def drift_velocity(t):
    _, k, _, c, _ = _obs(t)
    return observatory.drift_velocity(c, k)


@T.query(f"WITH {_OBS}, p AS (SELECT date_trunc('day', checked_at) AS period, CAST(sum(violation_count) AS BIGINT) AS total_violations FROM checks JOIN datasets USING (dataset_id) WHERE dataset_name = 'd3' GROUP BY 1) SELECT period, total_violations, round(CAST(1 AS DOUBLE) - total_violations / nullif(max(total_violations) OVER (), 0), 3) AS quality_score FROM p")
def quality_trend(t):
    d, _, _, _, q = _obs(t)
    return observatory.quality_trend(q, d, "d3")


@T.query(f"WITH {_OBS} SELECT dataset_name, column_name, change_type, tier, requires_migration, requires_backfill, detected_at FROM changes JOIN datasets USING (dataset_id) JOIN kinds USING (evo_type_id) WHERE requires_migration OR requires_backfill")
def migration_backlog(t):
    d, k, _, c, _ = _obs(t)
    return observatory.migration_backlog(c, d, k)


@T.query(f"WITH {_OBS} SELECT dataset_name, rule_name, severity, count(*) AS check_count, CAST(sum(violation_count) AS BIGINT) AS total_violations, round(CAST(sum(violation_count) AS DOUBLE) / count(*), 1) AS avg_violations FROM checks JOIN datasets USING (dataset_id) JOIN rules USING (rule_id) GROUP BY 1, 2, 3")
def rule_heatmap(t):
    d, _, r, _, q = _obs(t)
    return observatory.rule_heatmap(q, d, r)


@T.query("SELECT p_partkey, upper(trim(p_name)) AS p_name, replace(p_brand, 'Brand', 'B') AS p_brand, lower(substr(p_type, 2, 4)) AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def str_transforms(t):
    on = transforms.on
    steps = [on("p_name").strip().upper(), on("p_brand").replace_all("Brand", "B"), on("p_type").slice(1, 4).lower(), on("p_size").cast("string")]
    return transforms.apply(t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), steps)


@T.query("SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS event_type, round(value * 2, 2) AS value FROM events")
def sql_transforms(t):
    return transforms.apply_sql(t("events").select("event_id", "event_type", "value"), {"event_type": "case when value > 100 then 'high' else 'low' end", "value": "round(value * 2, 2)"})


@T.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@T.query("SELECT l_orderkey, len(a) AS n, a[1] AS first_part, a[-1] AS last_part, CAST(list_sum(list_transform(a, lambda x: x % 7)) AS BIGINT) AS total, list_contains(a, 5) AS has_five FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS a FROM lineitem GROUP BY 1)")
def array_functions(t):
    """On the parts of each order (an order has few lines)."""
    a = columns.listed(t("lineitem"), ["l_orderkey"], "l_partkey", "l_partkey", "a")
    total = columns.list_sum(F.transform("a", lambda x: x % 7)).cast("bigint")
    five = F.array_contains("a", F.lit(5).cast("bigint"))
    return a.select("l_orderkey", columns.list_count("a").alias("n"), columns.list_first("a").alias("first_part"), columns.list_last("a").alias("last_part"), total.alias("total"), five.alias("has_five"))


@T.query("SELECT event_id, CAST(bit_count(event_id) AS BIGINT) AS bits, event_id & 255 AS low, event_id << 3 AS shifted FROM events")
def bit_functions(t):
    i = F.col("event_id")
    return t("events").select("event_id", columns.bits_set(i).alias("bits"), i.bitwiseAND(255).alias("low"), F.shiftleft(i, 3).alias("shifted"))


@T.query("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, week(o_orderdate) AS w, isodow(o_orderdate) - 1 AS dow, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS since FROM orders")
def date_parts(t):
    c = F.col("o_orderdate")
    parts = {"y": F.year(c), "q": F.quarter(c), "m": F.month(c), "d": F.dayofmonth(c), "w": F.weekofyear(c), "dow": F.weekday(c), "since": columns.days_between(F.lit("1995-01-01"), c)}
    return t("orders").select("o_orderkey", *(v.cast("bigint").alias(n) for n, v in parts.items()))


_LOG = "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 5 <> 0"


def _log(t):
    """A change log: events are created, those whose id divides by five deleted."""
    row = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    gone = F.col("event_id") % 5 == 0
    m = F.struct(F.when(gone, "d").otherwise("c").alias("op"), F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"))
    return readers.changes(t("events").select(F.to_json(m).alias("m")), "m", "id bigint, kind string", ["id"])


@T.query(_LOG)
def cdc_upserts(t):
    return _log(t)[0]


@T.query("SELECT event_id AS id FROM events WHERE event_id % 5 = 0")
def cdc_deletes(t):
    return _log(t)[1]


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@T.query("""SELECT event_type, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM events GROUP BY ALL""")
def event_tumbling(t):
    return _ntz(streams.windowed(t("events"), "ts", "1 hour", F.count("*").alias("n"), by=("event_type",)))


@T.query("""SELECT s AS start, s + INTERVAL 2 HOUR AS "end", count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL""")
def event_sliding(t):
    return _ntz(streams.windowed(t("events"), "ts", "2 hours", F.count("*").alias("n"), slide="1 hour"))


@T.query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, no""")
def event_session(t):
    return _ntz(streams.sessions(t("events"), "ts", "6 hours", F.count("*").alias("n"), by=("user_id",)))
