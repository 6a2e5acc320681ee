"""Graph operators on nations (25 vertices, weighted and labelled edges) and on the customers and suppliers of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities, graph, schema_graph
from .common import CUST_HIST_SQL, Topic, cust_hist

T = Topic()
QUERIES, ORACLES = T.QUERIES, T.ORACLES

_E = """e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS dst, 1.0 + n_nationkey % 4 AS w, 'a' AS label FROM nation
 UNION ALL SELECT n_nationkey, n_nationkey + 1, 2.0, 'b' FROM nation WHERE n_nationkey % 5 < 3)"""
_BOTH = "u AS (SELECT src, dst, w, label FROM e UNION ALL SELECT dst, src, w, label FROM e)"
#: Simple paths of up to three edges.
_PATHS = """p AS (SELECT src AS first, dst AS last, 1 AS hops, [src, dst] AS path, [label] AS labels, CAST(w AS DOUBLE) AS weight FROM e WHERE src <> dst
 UNION ALL SELECT first, dst, hops + 1, list_append(path, dst), list_append(labels, label), weight + w FROM p JOIN e ON last = src WHERE hops < 3 AND NOT list_contains(path, dst))"""
#: Distances from every vertex.
_DIST = """w AS (SELECT DISTINCT src AS source, src AS id, 0 AS d FROM (SELECT src FROM e UNION SELECT dst FROM e)
 UNION SELECT source, dst, d + 1 FROM w JOIN e ON id = src WHERE d < 25), dist AS (SELECT source, id, CAST(min(d) AS BIGINT) AS distance FROM w GROUP BY 1, 2)"""
_TRADE = "trade AS (SELECT o_custkey AS src, l_suppkey AS dst, l_quantity AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(t):
    n = t("nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    a = n.select(F.col("n").alias("src"), ((F.col("n") * 7 + 3) % 25).alias("dst"), (1.0 + F.col("n") % 4).alias("w"), F.lit("a").alias("label"))
    return a.union(n.filter("n % 5 < 3").select("n", F.col("n") + 1, F.lit(2.0), F.lit("b")))


def _trade(t):
    o, i = t("orders").select("o_orderkey", F.col("o_custkey").alias("src")), t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("w"))
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst", "w")


def _ids(t, *ids):
    return t("nation").sparkSession.createDataFrame([(i,) for i in ids], "id bigint")


_START = "SELECT DISTINCT {a} AS id, {b} AS neighbor FROM {t}"


@T.query(f"WITH {_TRADE} {_START.format(a='src', b='dst', t='trade')}")
def neighbors_out(t):
    return graph.neighbors(_trade(t), t("customer").select(F.col("c_custkey").alias("id")), "out")


@T.query(f"WITH {_TRADE} {_START.format(a='dst', b='src', t='trade')}")
def neighbors_in(t):
    return graph.neighbors(_trade(t), t("supplier").select(F.col("s_suppkey").alias("id")), "in")


@T.query(f"WITH {_E}, {_BOTH} SELECT DISTINCT src AS id, dst AS neighbor FROM u WHERE src IN (3, 12)")
def neighbors_both(t):
    return graph.neighbors(_edges(t), _ids(t, 3, 12), "both")


@T.query(f"WITH {CUST_HIST_SQL}, {_TRADE} SELECT DISTINCT dst AS id, src AS neighbor FROM trade WHERE src IN (SELECT c_custkey FROM cust_hist WHERE c_mktsegment = 'MOVED' AND valid_from <= TIMESTAMP '1999-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-01-01'))")
def neighbors_asof(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"))
    return graph.neighbors_asof(_trade(t), s, cust_hist(t).filter("c_mktsegment = 'MOVED'"), "c_custkey", "1999-01-01", "in")


_SHOWN = "array_to_string(path, '>') AS path"


def _shown(df, *cols):
    return df.select(*cols, F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@T.query(f"WITH RECURSIVE {_E}, {_PATHS} SELECT first, last, CAST(hops AS BIGINT) AS hops, {_SHOWN} FROM p WHERE first = 1 AND last IN (2, 13, 20)")
def paths_k3(t):
    return _shown(graph.paths(_edges(t), _ids(t, 1), 3, _ids(t, 2, 13, 20)), "first", "last", "hops")


@T.query(f"WITH RECURSIVE {_E}, {_BOTH}, {_PATHS.replace('FROM e', 'FROM u').replace('JOIN e', 'JOIN u')} SELECT first, last, CAST(hops AS BIGINT) AS hops, {_SHOWN} FROM p WHERE first = 1 AND last IN (2, 13, 20)")
def paths_undirected(t):
    return _shown(graph.paths(graph.undirected(_edges(t)), _ids(t, 1), 3, _ids(t, 2, 13, 20)), "first", "last", "hops")


def _pick(by, k):
    return f"WITH RECURSIVE {_E}, {_PATHS} SELECT first, last, {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY first, last ORDER BY {by}, path) AS r FROM p) WHERE r <= {k}"


@T.query(_pick("hops", 1))
def path_shortest(t):
    return _shown(graph.chosen_paths(graph.paths(_edges(t), None, 3), "SHORTEST"), "first", "last")


@T.query(_pick("hops", 2))
def k_shortest(t):
    return _shown(graph.chosen_paths(graph.paths(_edges(t), None, 3), "K_SHORTEST", 2), "first", "last")


@T.query(_pick("weight", 1))
def path_min_weight(t):
    return _shown(graph.chosen_paths(graph.paths(_edges(t), None, 3), "MIN_WEIGHT"), "first", "last")


@T.query(f"WITH {_TRADE} SELECT src AS id, sum(w) AS value FROM trade GROUP BY 1")
def incident_sum(t):
    return graph.incident(_trade(t), F.sum("w"))


@T.query("SELECT o_custkey AS id, round(sum(l_extendedprice * l_discount), 2) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def weighted_sum(t):
    """A measure allocated by a weight: both are columns of the edge."""
    i = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"), "l_extendedprice", "l_discount")
    e = t("orders").select("o_orderkey", F.col("o_custkey").alias("src")).join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst", "l_extendedprice", "l_discount")
    return graph.incident(e, F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2))


for _d, _ends in (("out", (1, 0)), ("in", (0, 1)), ("both", (1, 1))):
    T.query(f"WITH {_E} SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT src AS id, {_ends[0]} AS n FROM e UNION ALL SELECT dst, {_ends[1]} FROM e) GROUP BY 1", name=f"degree_{_d}")(lambda t, d=_d: graph.degree(_edges(t), d))

_RANKS = "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)" + "".join(
    f""", r{i} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + CAST(0.85 AS DOUBLE) * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v)) AS rank
 FROM v LEFT JOIN (SELECT e.dst, sum(rank / outs) AS got FROM e JOIN r{i - 1} r ON e.src = r.id JOIN (SELECT src, count(*) AS outs FROM e GROUP BY 1) o ON o.src = e.src GROUP BY 1) g ON g.dst = v.id)"""
    for i in (1, 2, 3)
)


@T.query(f"WITH {_E}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), {_RANKS} SELECT id, round(rank, 9) AS rank FROM r3")
def pagerank_3iter(t):
    return graph.pagerank(_edges(t), 0.85, 3).select("id", F.round("rank", 9).alias("rank"))


@T.query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 5 AS BIGINT) AS component FROM nation")
def connected_components(t):
    """A chain of the nations in each residue of five: each next one is five keys on."""
    n = F.col("n_nationkey").cast("bigint")
    return graph.connected_components(t("nation").filter("n_nationkey < 20").select(n.alias("src"), (n + 5).alias("dst")))


@T.query(f"WITH RECURSIVE {_E}, {_DIST} SELECT a.source AS id, min(a.id) AS component FROM dist a JOIN dist b ON a.source = b.id AND a.id = b.source GROUP BY 1")
def scc(t):
    return graph.strong_components(_edges(t))


@T.query(f"WITH RECURSIVE {_E}, {_DIST} SELECT source, id, distance FROM dist")
def bfs_distance(t):
    return graph.distances(_edges(t)).select("source", "id", "distance")


@T.query(f"WITH RECURSIVE {_E}, w AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS s, 0 AS d UNION SELECT dst, s + w, d + 1 FROM w JOIN e ON id = src WHERE d < 25) SELECT CAST(1 AS BIGINT) AS source, id, min(s) AS weight FROM w GROUP BY 2")
def min_weight_path(t):
    return graph.least_weights(_edges(t), _ids(t, 1))


@T.query(f"WITH RECURSIVE {_E}, {_DIST} SELECT id FROM dist WHERE source = 1")
def reachable(t):
    return graph.reachable(_edges(t), _ids(t, 1))


@T.query(f"WITH {_E}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)) AS density FROM v")
def density(t):
    return graph.density(_edges(t))


@T.query(f"WITH RECURSIVE {_E}, {_DIST} SELECT max(distance) AS diameter FROM dist")
def diameter(t):
    return graph.diameter(_edges(t))


@T.query(f"WITH RECURSIVE {_E}, {_DIST} SELECT source AS id, CASE WHEN sum(distance) > 0 THEN CAST(count(*) - 1 AS DOUBLE) / sum(distance) ELSE 0 END AS closeness FROM dist GROUP BY 1")
def closeness(t):
    return graph.closeness(_edges(t))


#: Distances and numbers of shortest paths between all vertices; edges that repeat count once.
_COUNTED = """x AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
 walk AS (SELECT DISTINCT src AS source, src AS id, 0 AS d, [src] AS path FROM (SELECT src FROM x UNION SELECT dst FROM x)
 UNION ALL SELECT walk.source, dst, d + 1, list_append(path, dst) FROM walk JOIN x ON walk.id = src JOIN dist ON dist.source = walk.source AND dist.id = dst AND dist.distance = d + 1)"""


@T.query(f"""WITH RECURSIVE {_E}, {_DIST}, {_COUNTED}, n AS (SELECT source, id, count(*) AS n FROM walk GROUP BY 1, 2),
 through AS (SELECT source, id, path[i] AS v, count(*) AS k FROM (SELECT source, id, path, unnest(range(2, len(path))) AS i FROM walk) GROUP BY 1, 2, 3)
SELECT z.id, round(coalesce(sum(k / n), 0), 6) AS betweenness FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) z LEFT JOIN through ON v = z.id LEFT JOIN n ON n.source = through.source AND n.id = through.id GROUP BY 1""")
def betweenness(t):
    return graph.betweenness(_edges(t)).select("id", F.round("betweenness", 6).alias("betweenness"))


_VOTES = "both_ways AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst), l0 AS (SELECT id, id AS c FROM (SELECT src AS id FROM e UNION SELECT dst FROM e))" + "".join(
    f", l{i} AS (SELECT l.id, coalesce(b.c, l.c) AS c FROM l{i - 1} l LEFT JOIN (SELECT dst, c FROM (SELECT dst, c, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, c) AS r FROM both_ways JOIN l{i - 1} ON id = src GROUP BY dst, c) WHERE r = 1) b ON b.dst = l.id)"
    for i in (1, 2, 3)
)


@T.query(f"WITH {_E}, {_VOTES} SELECT id, c AS community FROM l3")
def label_propagation(t):
    return graph.label_propagation(_edges(t), 3)


def _cliques(t):
    """Nations in five groups by residue, all tied within a group, and each group to the next by one edge."""
    n = t("nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    inside = n.alias("a").join(n.alias("b"), (F.col("a.n") % 5 == F.col("b.n") % 5) & (F.col("a.n") < F.col("b.n"))).select(F.col("a.n").alias("src"), F.col("b.n").alias("dst"))
    return inside.union(n.filter("n < 5").select("n", ((F.col("n") + 1) % 5)))


@T.query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 5 AS BIGINT) AS community FROM nation")
def louvain(t):
    """The groups are the communities of greatest modularity."""
    return communities.louvain(_cliques(t))


@T.query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(0 AS BIGINT) AS community FROM nation")
def community_label(t):
    return communities.community_label(_cliques(t), "connected_components")


@T.query("""WITH out AS (SELECT sum(c) AS f FROM (SELECT 5.0 AS c UNION ALL SELECT 7.0)), mid AS (SELECT least(5.0, 3.0 + 2.0) + least(7.0, 4.0) AS f) SELECT CAST(least(out.f, mid.f) AS DOUBLE) AS flow FROM out, mid""")
def max_flow(t):
    """Two ways from 0 to 9, each narrowed in its middle; the least cut is 5 + 4."""
    e = _edges(t).sparkSession.createDataFrame([(0, 1, 5.0), (0, 2, 7.0), (1, 3, 3.0), (1, 4, 2.0), (2, 4, 4.0), (3, 9, 9.0), (4, 9, 9.0), (9, 0, 50.0), (5, 6, 8.0)], "src bigint, dst bigint, w double")
    return communities.max_flow(e, 0, 9)


@T.query(f"WITH {_E}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT n_nationkey, n_name, d.degree FROM nation LEFT JOIN d ON d.id = n_nationkey")
def node_expr(t):
    """An algorithm's value of each row's vertex."""
    rows = t("nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    return communities.node_column(rows, graph.degree(_edges(t)), "n_nationkey", "degree")


@T.query(f"WITH RECURSIVE {_E}, {_DIST} SELECT a.n_name AS a, b.n_name AS b, distance AS hops FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey LEFT JOIN dist ON source = a.n_nationkey AND id = b.n_nationkey")
def pair_expr(t):
    """An algorithm's value of each row's pair of vertices."""
    side = lambda c: t("nation").select(F.col("n_nationkey").cast("bigint").alias(f"k{c}"), F.col("n_name").alias(c), F.col("n_regionkey").alias(f"r{c}"))
    rows = side("a").join(side("b"), F.col("ra") == F.col("rb"))
    return communities.pair_column(rows, graph.distances(_edges(t)), ("ka", "kb"), "hops").select("a", "b", "hops")


@T.query(f"WITH {_E} SELECT n_name, (SELECT count(*) FROM e) AS edges, c.n AS in_region FROM nation JOIN (SELECT n_regionkey AS r, count(*) AS n FROM e JOIN nation ON n_nationkey = src GROUP BY 1) c ON c.r = n_regionkey")
def subgraph_expr(t):
    """A value of the whole graph, and one of each partition's."""
    e = _edges(t)
    rows = t("nation").select("n_name", "n_regionkey")
    whole = communities.graph_column(rows, e.agg(F.count("*").alias("n")), "edges")
    part = e.join(t("nation").select(F.col("n_nationkey").cast("bigint").alias("src"), "n_regionkey"), "src").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return communities.graph_column(whole, part, "in_region", ["n_regionkey"]).select("n_name", "edges", "in_region")


@T.query(f"WITH {_TRADE} SELECT max(o_orderdate) AS fresh, (SELECT count(*) FROM (SELECT DISTINCT src FROM trade WHERE dst = 3)) AS buyers FROM orders")
def graph_model(t):
    """A declared graph: how fresh an edge type is, and a supplier's neighbours found by key."""
    v = [schema_graph.Vertex("customer", "customer", "c_custkey", ("c_name",)), schema_graph.Vertex("supplier", "supplier", "s_suppkey", ("s_suppkey",))]
    e = [schema_graph.EdgeType("buys", "trade", "customer", "src", "supplier", "dst", {"w": True}, "line"), schema_graph.EdgeType("orders", "orders", "customer", "o_custkey", "customer", "o_custkey", time="o_orderdate")]
    m = schema_graph.GraphModel(schema_graph.SchemaGraph(v, e), lambda n: _trade(t) if n == "trade" else t(n))
    buyers = m.neighbors("buys", m.by_key("supplier", 3).select(F.col("s_suppkey").alias("id")), "in").agg(F.count("*").alias("buyers"))
    return communities.graph_column(m.freshness("orders"), buyers, "buyers")


@T.query(f"WITH {_TRADE}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1) SELECT (SELECT count(*) FROM trade) AS edges, count(*) AS vertices, max(n) AS max_degree, avg(n) AS mean_degree FROM d")
def graph_statistics(t):
    return graph.statistics(_trade(t))


_SIG = "s AS (SELECT first, last, array_to_string(labels, '>') AS signature FROM p)"


def _found(t, reverse=False):
    e = _edges(t)
    return graph.paths(graph.reversed_edges(e) if reverse else e, None, 3)


@T.query(f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG} SELECT first, count(DISTINCT signature) AS signatures, count(DISTINCT signature) / count(*) AS diversity FROM s GROUP BY 1")
def signatures_out(t):
    return graph.distinct_signatures(_found(t), ("first",))


@T.query(f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG} SELECT last, count(DISTINCT signature) AS signatures FROM s GROUP BY 1")
def signatures_in(t):
    return graph.distinct_signatures(_found(t, True), ("first",)).select(F.col("first").alias("last"), "signatures")


def _dominant(by):
    keys = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG} SELECT {keys}signature, paths FROM (SELECT *, row_number() OVER ({part}ORDER BY paths DESC, signature) AS r FROM (SELECT {keys}signature, count(*) AS paths FROM s GROUP BY {keys}signature)) WHERE r = 1"


for _n, _by in (("dominant_signature_out", ("first",)), ("dominant_signature_in", ("last",)), ("dominant_signature_pair", ("first", "last")), ("dominant_signature_global", ())):
    T.query(_dominant(_by), name=_n)(lambda t, by=_by: graph.dominant_signature(_found(t), by))


@T.query(f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG} SELECT first, last, count(DISTINCT signature) AS signatures FROM s GROUP BY 1, 2")
def signatures_pair(t):
    return graph.distinct_signatures(_found(t), ("first", "last")).select("first", "last", "signatures")


@T.query(f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG} SELECT count(DISTINCT signature) AS signatures, count(DISTINCT signature) / count(*) AS diversity FROM s")
def signatures_global(t):
    return graph.distinct_signatures(_found(t))


@T.query(f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG}, c AS (SELECT first, signature, count(*) AS n FROM s GROUP BY 1, 2), q AS (SELECT first, n / sum(n) OVER (PARTITION BY first) AS p FROM c) SELECT first, round(abs(sum(p * log2(p))), 6) AS entropy FROM q GROUP BY 1")
def signature_entropy(t):
    return graph.signature_entropy(_found(t), ("first",)).select("first", F.round(F.abs("entropy"), 6).alias("entropy"))


@T.query(f"WITH RECURSIVE {_E}, {_PATHS}, {_SIG} SELECT first, avg(CASE WHEN signature = 'a>b' THEN 1 ELSE 0 END) AS similarity FROM s GROUP BY 1")
def signature_similarity(t):
    return graph.signature_similarity(_found(t), ["a", "b"], ("first",))


for _n, _args, _where in (
    ("exact", (["a", None, "b"], "EXACT"), "len(labels) = 3 AND labels[1] = 'a' AND labels[3] = 'b'"),
    ("prefix", (["b", "a"], "PREFIX"), "labels[1] = 'b' AND labels[2] = 'a'"),
    ("contains", (["b", "a"], "CONTAINS"), "array_to_string(labels, '') LIKE '%ba%'"),
    ("regex", (["a(>b)+"], "REGEX"), "regexp_full_match(array_to_string(labels, '>'), 'a(>b)+')"),
):
    T.query(f"WITH RECURSIVE {_E}, {_PATHS} SELECT first, last, {_SHOWN} FROM p WHERE {_where}", name=f"signature_pred_{_n}")(lambda t, a=_args: _shown(_found(t).filter(graph.matches_signature(F.col("labels"), *a)), "first", "last"))

_CONE = "f AS (SELECT id FROM dist WHERE source = 1), b AS (SELECT source AS id FROM dist WHERE id = 13)"
for _n, _s, _t, _where in (
    ("from", 1, None, "src IN (FROM f) AND dst IN (FROM f)"),
    ("to", None, 13, "src IN (FROM b) AND dst IN (FROM b)"),
    ("between", 1, 13, "src IN (FROM f) AND dst IN (FROM f) AND src IN (FROM b) AND dst IN (FROM b)"),
):
    T.query(f"WITH RECURSIVE {_E}, {_DIST}, {_CONE} SELECT src, dst, label FROM e WHERE {_where}", name=f"trim_reachable_{_n}")(lambda t, s=_s, z=_t: graph.trim_reachable(_edges(t), None if s is None else _ids(t, s), None if z is None else _ids(t, z)).select("src", "dst", "label"))


@T.query(f"WITH {_E}, d AS (SELECT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 HAVING count(*) >= 3) SELECT src, dst, label FROM e WHERE src IN (FROM d) AND dst IN (FROM d)")
def trim_min_degree(t):
    return graph.trim_min_degree(_edges(t), 3).select("src", "dst", "label")


def _chain(t):
    """Two cycles with tails before and behind: nations 0 to 3 in a ring, 4 to 6 behind it, 7 to 9 before it."""
    return _edges(t).sparkSession.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 6), (7, 8), (8, 9), (9, 0)], "src bigint, dst bigint")


_RING = "SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM (VALUES (0, 1), (1, 2), (2, 3), (3, 0)"


@T.query(f"{_RING}, (7, 8), (8, 9), (9, 0)) x(a, b)")
def trim_sink_free(t):
    return graph.trim_dead_ends(_chain(t), "SINK_FREE").select("src", "dst")


@T.query(f"{_RING}, (3, 4), (4, 5), (5, 6)) x(a, b)")
def trim_source_free(t):
    return graph.trim_dead_ends(_chain(t), "SOURCE_FREE").select("src", "dst")
