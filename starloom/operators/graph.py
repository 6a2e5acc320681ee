"""Traversal and algorithms on edge tables (src, dst[, w][, label]).

All are joins and aggregations of DataFrames.  Loops run by level or to a fixed
point, one checkpoint a round, so that plans stay short and no vertex set comes to
the driver; only counts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    """Edges and their reverses."""
    return edges.union(reversed_edges(edges))


def reversed_edges(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _facing(edges: DataFrame, direction: str) -> DataFrame:
    return {"out": lambda: edges, "in": lambda: reversed_edges(edges), "both": lambda: undirected(edges)}[direction.lower()]()


def neighbors(edges: DataFrame, starts: DataFrame, direction: str = "out") -> DataFrame:
    """(id, neighbor), distinct, for each id of ``starts``."""
    e = _facing(edges, direction).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
    return e.join(starts.select("id"), "id", "left_semi").distinct()


def neighbors_asof(edges: DataFrame, starts: DataFrame, history: DataFrame, key: str, at: str, direction: str = "out") -> DataFrame:
    """Neighbours that have a version valid at a time (valid_from <= at < valid_to)."""
    when = F.lit(at).cast("timestamp_ntz")
    valid = history.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))
    return neighbors(edges, starts, direction).join(valid.select(F.col(key).alias("neighbor")), "neighbor", "left_semi").select("id", "neighbor")


def paths(edges: DataFrame, starts: DataFrame | None, max_hops: int, ends: DataFrame | None = None) -> DataFrame:
    """(first, last, hops, path, labels, weight): all simple paths of 1 to ``max_hops`` edges.

    One join a hop.  Labels and weights are there if the edges have them (null
    otherwise); parallel edges make paths of their own.  With ``ends`` only edges
    that can still reach one in the hops left are followed.
    """
    has = set(edges.columns)
    step = edges.select("src", "dst", (F.col("label") if "label" in has else F.lit(None).cast("string")).alias("label"), (F.col("w").cast("double") if "w" in has else F.lit(None).cast("double")).alias("w"))
    if starts is None:
        starts = edges.select(F.col("src").alias("id")).distinct()
    near = [None] * (max_hops + 1)
    if ends is not None:
        near[0] = ends.select("id").distinct()
        for i in range(1, max_hops):
            near[i] = near[i - 1].union(step.join(near[i - 1], F.col("dst") == F.col("id"), "left_semi").select("src")).distinct()
    now = starts.select(F.col("id").alias("first"), F.col("id").alias("last"), F.array("id").alias("path"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))
    levels = []
    for hop in range(1, max_hops + 1):
        usable = step if ends is None else step.join(near[max_hops - hop], F.col("dst") == F.col("id"), "left_semi")
        now = now if hop == 1 else checkpointed(now)  # the levels' union would compute the first ones again and again
        now = now.join(usable, [F.col("last") == F.col("src"), ~F.array_contains("path", F.col("dst"))]).select("first", F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("labels", F.col("label")).alias("labels"), (F.col("weight") + F.col("w")).alias("weight"))
        levels.append(now.select("first", "last", F.lit(hop).cast("bigint").alias("hops"), "path", "labels", "weight"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out if ends is None else out.join(ends.select(F.col("id").alias("last")).distinct(), "last", "left_semi").select("first", "last", "hops", "path", "labels", "weight")


def chosen_paths(found: DataFrame, strategy: str, k: int = 1) -> DataFrame:
    """Of each pair's paths: ALL; the first (SHORTEST) or first k (K_SHORTEST) by hops, then path; MIN_WEIGHT by weight, then path."""
    if strategy == "ALL":
        return found
    by = ["weight", "path"] if strategy == "MIN_WEIGHT" else ["hops", "path"]
    return found.withColumn("_r", F.row_number().over(W.partitionBy("first", "last").orderBy(*by))).filter(F.col("_r") <= (k if strategy == "K_SHORTEST" else 1)).drop("_r")


def incident(edges: DataFrame, value: Column, direction: str = "out") -> DataFrame:
    """(id, value) of an aggregate over each vertex's incident edges (``both``: a loop counts twice)."""
    return _facing(edges, direction).groupBy(F.col("src").alias("id")).agg(value.alias("value"))


def degree(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(id, degree) of every vertex, 0 included."""
    out = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction.lower()]
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(c).alias("id"), F.lit(int(c in out)).alias("n")) for c in ("src", "dst")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.n").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, rank), ranks adding up to 1; a vertex without outgoing edges gives its rank to all alike."""
    outs = edges.groupBy("src").agg(F.count("*").alias("outs"))
    links = checkpointed(edges.join(outs, "src").select("src", "dst", "outs"))
    ids = checkpointed(vertices(edges).join(outs.select(F.col("src").alias("id"), F.lit(True).alias("gives")), "id", "left"))
    n = ids.count()
    ranks = ids.select("id", "gives", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        got = links.join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("outs")).alias("got"))
        share = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + lost / max(n, 1))
        ranks = checkpointed(ids.join(got, "id", "left").select("id", "gives", share.alias("rank")))
    return ranks.select("id", "rank")


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Least label along directed edges until nothing changes: as many rounds as the longest way a label goes."""
    told = None
    while True:
        came = edges.join(labels, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label")
        labels = checkpointed(labels.union(came).groupBy("id").agg(F.min("label").alias("label")))
        now = labels.agg(F.sum(F.xxhash64("id", "label").cast("decimal(20,0)"))).first()[0]
        if now == told:
            return labels
        told = now


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is weakly connected with it.

    Alternates large-star and small-star steps, whose rounds grow with the logarithm
    of a component's size, not with its diameter.
    """
    now, told = checkpointed(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        moved = stars.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = checkpointed(moved.filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == told:
            break
        told = state
    root = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return vertices(edges).join(root, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that reaches it and is reached by it.

    Colouring: the least id that reaches a vertex is its colour; those of a colour that
    reach the colour's own vertex are a strong component.  Found ones go, the rest repeats.
    """
    rest = checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())
    left, done = checkpointed(vertices(edges)), None
    while not left.isEmpty():
        colour = _spread(left.select("id", F.col("id").alias("label")), rest)
        a, b = (colour.select(F.col("id").alias(s), F.col("label").alias(c)) for s, c in (("src", "c1"), ("dst", "c2")))
        inside = checkpointed(rest.join(a, "src").join(b, "dst").filter("c1 = c2").select("src", "dst"))
        # backwards from each colour's own vertex, along edges within the colour
        found = checkpointed(colour.filter("id = label"))
        front = found
        while not front.isEmpty():
            back = inside.join(front, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "label").distinct()
            front = checkpointed(back.join(found, "id", "left_anti"))
            found = checkpointed(found.union(front))
        part = found.select("id", F.col("label").alias("component"))
        done = part if done is None else checkpointed(done.union(part))
        left = checkpointed(left.join(found, "id", "left_anti"))
        rest = checkpointed(rest.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0) if done is None else done


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): each round a vertex takes its neighbours' most frequent label, of several the smallest."""
    both = checkpointed(undirected(edges.select("src", "dst").filter("src <> dst")).distinct())
    labels = checkpointed(vertices(edges).select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        votes = both.join(labels, F.col("src") == F.col("id")).groupBy("dst", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(-F.col("n"), "community"))["community"].alias("new"))
        labels = checkpointed(labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    return labels


def distances(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(source, id, distance, shortest): fewest edges from each source to each vertex it reaches, and how many such paths there are."""
    step = checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())
    first = (vertices(edges) if starts is None else starts.select("id").distinct())
    known = front = checkpointed(first.select(F.col("id").alias("source"), "id", F.lit(0).cast("bigint").alias("distance"), F.lit(1).cast("bigint").alias("shortest")))
    level = 0
    while not front.isEmpty():
        level += 1
        came = front.join(step, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("shortest").alias("shortest"))
        front = checkpointed(came.join(known, ["source", "id"], "left_anti").select("source", "id", F.lit(level).cast("bigint").alias("distance"), "shortest"))
        known = checkpointed(known.union(front))
    return known


def least_weights(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(source, id, weight): least sum of weights (not negative) along a path; only improved vertices are relaxed again."""
    step = checkpointed(edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    best = front = checkpointed(starts.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("weight")).distinct())
    while not front.isEmpty():
        came = front.join(step, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("weight") + F.col("w")).alias("new"))
        front = checkpointed(came.join(best, ["source", "id"], "left").filter("weight is null or new < weight").select("source", "id", F.col("new").alias("weight")))
        best = checkpointed(best.union(front).groupBy("source", "id").agg(F.min("weight").alias("weight")))
    return best


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "out") -> DataFrame:
    """(id) of everything reached from any start, starts included."""
    step = checkpointed(_facing(edges.select("src", "dst").distinct(), direction))
    known = front = checkpointed(starts.select("id").distinct())
    while not front.isEmpty():
        front = checkpointed(step.join(front, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti"))
        known = checkpointed(known.union(front))
    return known


def density(edges: DataFrame) -> DataFrame:
    """One row: edges / (vertices * (vertices - 1))."""
    n = vertices(edges).agg(F.count("*").alias("v"))
    return edges.agg(F.count("*").alias("e")).join(n, F.lit(True)).select((F.col("e") / (F.col("v") * (F.col("v") - 1))).alias("density"))


def diameter(edges: DataFrame) -> DataFrame:
    """One row: the greatest finite distance."""
    return distances(edges).agg(F.max("distance").alias("diameter"))


def closeness(edges: DataFrame) -> DataFrame:
    """(id, closeness): other vertices reached / sum of their distances (0 if none is)."""
    d = distances(edges).groupBy(F.col("source").alias("id")).agg(F.sum("distance").alias("far"), (F.count("*") - 1).alias("n"))
    return d.select("id", F.when(F.col("far") > 0, F.col("n") / F.col("far")).otherwise(0.0).alias("closeness"))


def betweenness(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): over all sources the share of shortest paths through a vertex, from the farthest level back."""
    step = edges.select("src", "dst").filter("src <> dst").distinct()
    d = distances(edges, starts)
    near, far = (d.select("source", F.col("id").alias(c), F.col("distance").alias(f"d{c}"), F.col("shortest").alias(f"s{c}")) for c in ("src", "dst"))
    dag = checkpointed(near.join(step, "src").join(far, ["source", "dst"]).filter("ddst = dsrc + 1"))
    top = d.agg(F.max("distance")).first()[0] or 0
    given = total = None
    for level in range(top, 0, -1):
        part = dag.filter(F.col("ddst") == level)
        part = part.withColumn("late", F.lit(0.0)) if given is None else part.join(given.select("source", F.col("id").alias("dst"), "late"), ["source", "dst"], "left").withColumn("late", F.coalesce("late", F.lit(0.0)))
        given = checkpointed(part.groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("ssrc") / F.col("sdst") * (1 + F.col("late"))).alias("late")))
        total = given if total is None else total.union(given)
    ids = vertices(edges)
    if total is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    return ids.join(total.filter("source <> id").groupBy("id").agg(F.sum("late").alias("b")), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


# signatures: label sequences of simple paths

def signature_counts(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, signature, paths) from ``paths``."""
    return found.groupBy(*by, F.concat_ws(">", "labels").alias("signature")).agg(F.count("*").alias("paths"))


def distinct_signatures(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, signatures, diversity): distinct signatures, and their number divided by that of the paths."""
    return signature_counts(found, by).groupBy(*by).agg(F.count("*").alias("signatures"), (F.count("*") / F.sum("paths")).alias("diversity"))


def dominant_signature(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, signature, paths) of the most frequent signature, of several the first in text order."""
    best = F.min(F.struct(-F.col("paths"), "signature", "paths"))
    return signature_counts(found, by).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.signature", "_b.paths")


def signature_entropy(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, entropy) in bits: log2(n) - sum(c * log2(c)) / n of the signatures' path counts c."""
    c, n = F.col("paths"), F.sum("paths")
    return signature_counts(found, by).groupBy(*by).agg((F.log2(n) - F.sum(c * F.log2(c.cast("double"))) / n).alias("entropy"))


def signature_similarity(found: DataFrame, reference: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, similarity): the share of paths with exactly these labels."""
    same = F.concat_ws(">", "labels") == ">".join(reference)
    return found.groupBy(*by).agg(F.avg(same.cast("int")).alias("similarity"))


def matches_signature(labels: Column, pattern: list[str | None], mode: str = "EXACT") -> Column:
    """Whether a label array matches: EXACT, PREFIX, CONTAINS (None matches any label), or REGEX (one pattern, on labels joined by >)."""
    if mode == "REGEX":
        return F.concat_ws(">", labels).rlike(f"^(?:{pattern[0]})$")
    n = len(pattern)

    def at(i: Column) -> Column:
        out = F.lit(True)
        for k, p in enumerate(pattern):
            if p is not None:
                out = out & F.get(labels, i + k).eqNullSafe(F.lit(p))
        return out

    if mode == "CONTAINS":
        return (F.size(labels) >= n) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(labels) - n, F.lit(0))), at)
    return (F.size(labels) == n if mode == "EXACT" else F.size(labels) >= n) & at(F.lit(0))


# trimming: each returns the edges that stay

def _within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def trim_reachable(edges: DataFrame, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Edges among vertices reached from the source and reaching the target (either may be absent)."""
    if source is not None:
        edges = _within(edges, reachable(edges, source))
    if target is not None:
        edges = _within(edges, reachable(edges, target, "in"))
    return edges


def trim_min_degree(edges: DataFrame, n: int, direction: str = "both") -> DataFrame:
    """Edges among vertices of that degree at least, counted once on all edges."""
    return _within(edges, degree(edges, direction).filter(F.col("degree") >= n))


def trim_dead_ends(edges: DataFrame, kind: str) -> DataFrame:
    """Edges left when vertices without outgoing (SINK_FREE) or incoming edges (SOURCE_FREE) go, again and again."""
    far, near = ("dst", "src") if kind == "SINK_FREE" else ("src", "dst")
    edges = checkpointed(edges)
    n = edges.count()
    while True:
        edges = checkpointed(edges.join(edges.select(F.col(near).alias(far)).distinct(), far, "left_semi").select(edges.columns))
        if (now := edges.count()) == n:
            return edges
        n = now


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, vertices, and greatest and mean degree."""
    d = degree(edges).agg(F.count("*").alias("vertices"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
    return edges.agg(F.count("*").alias("edges")).join(d, F.lit(True))
