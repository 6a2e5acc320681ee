"""Communities by modularity, maximum flow, and algorithms' results tied to rows."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError
from ..storage import checkpointed
from . import graph


def _moved(links: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """Communities after one round: vertices whose turn it is go where modularity gains most, if it gains."""
    pull = links.join(state.select(F.col("id").alias("dst"), F.col("community").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("pull"))
    mass = state.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("mass"))
    own = state.select("id", F.col("community").alias("c"), F.lit(0.0).alias("pull"))
    options = pull.union(own).groupBy("id", "c").agg(F.sum("pull").alias("pull")).join(mass, "c").join(state, "id")
    here = F.col("c") == F.col("community")
    gain = F.col("pull") - F.col("k") * (F.col("mass") - F.when(here, F.col("k")).otherwise(0.0)) / F.lit(total)
    # equal gains: stay, else the smallest community
    best = options.groupBy("id", "community", "k").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), here.cast("int").alias("stay"), (-F.col("c")).alias("c")))["c"].alias("to"))
    mine = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
    return best.select("id", F.when(mine, -F.col("to")).otherwise(F.col("community")).alias("community"), "k")


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 6) -> DataFrame:
    """(id, community): groups of high modularity, named by their smallest id.  Ids are numbers; w (1 if absent) are weights.

    Local moves by rounds, in each of which a changing half of the vertices moves (all at
    once would swap for ever); then each community becomes a vertex, and so on, until a
    level moves nothing or ``levels`` are done.  Each round is three joins of the links.
    """
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    plain = edges.select("src", "dst", w.alias("w")).filter("src is not null and dst is not null")
    both = plain.union(plain.select("dst", "src", "w"))
    links = checkpointed(both.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    names = checkpointed(graph.vertices(plain).select("id", F.col("id").alias("node")))
    total = links.agg(F.sum("w")).first()[0]
    for _ in range(levels if total else 0):
        degrees = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
        state = checkpointed(degrees.select("id", F.col("id").alias("community"), "k"))
        loose = checkpointed(links.filter("src <> dst"))
        quiet = 0
        for turn in range(rounds):
            after = checkpointed(_moved(loose, state, total, turn))
            same = after.join(state.select("id", F.col("community").alias("was")), "id").filter("community <> was").isEmpty()
            quiet, state = quiet + 1 if same else 0, after
            if quiet == 2:  # both halves have had a turn
                break
        if state.filter("id <> community").isEmpty():
            break
        to = state.select("id", "community")
        names = checkpointed(names.join(to.select(F.col("id").alias("node"), "community"), "node").select("id", F.col("community").alias("node")))
        links = links.join(to.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(to.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        links = checkpointed(links.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    least = names.groupBy("node").agg(F.min("id").alias("community"))
    return names.join(least, "node").select("id", "community")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of (id, community) on the undirected edges."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    a, b = (labels.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in ("src", "dst"))
    e = e.join(a, "src").join(b, "dst")
    total = e.agg(F.sum("w")).first()[0]
    inside = e.filter("csrc = cdst").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    mass = e.select(F.col("csrc").alias("c"), "w").union(e.select("cdst", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / total - mass.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * total * total)


def community_label(edges: DataFrame, algorithm: str = "louvain", **options) -> DataFrame:
    """(id, community) by louvain, label_propagation, connected_components or strong_components."""
    known = {"louvain": louvain, "label_propagation": graph.label_propagation, "connected_components": graph.connected_components, "strong_components": graph.strong_components}
    if algorithm not in known:
        raise SemanticError(f"no community algorithm {algorithm!r}")
    out = known[algorithm](edges, **options)
    return out.withColumnRenamed("component", "community")


def max_flow(edges: DataFrame, source: int, target: int, capacity: str = "w", most_edges: int = 5_000_000) -> DataFrame:
    """One row, flow: the greatest flow from source to target (Edmonds-Karp on the edges that can carry any).

    Parallel edges are added up.  The search for augmenting paths is sequential by nature
    and runs in one task, on the edges that the source reaches and that reach the target;
    more than ``most_edges`` of these are an error, not a sample.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0.0,)], "flow double")
    usable = edges.select("src", "dst", F.col(capacity).cast("double").alias("w")).filter("w > 0 and src <> dst")
    ends = [spark.createDataFrame([(v,)], f"id {edges.schema['src'].dataType.simpleString()}") for v in (source, target)]
    cone = checkpointed(graph.trim_reachable(usable.groupBy("src", "dst").agg(F.sum("w").alias("w")), *ends))
    if (n := cone.count()) > most_edges:
        raise SemanticError(f"{n} edges carry flow; one task takes {most_edges}")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        left: dict[int, dict[int, float]] = {}
        for a, b, w in zip(frame["src"], frame["dst"], frame["w"], strict=True):
            left.setdefault(a, {})[b] = left.get(a, {}).get(b, 0.0) + w
            left.setdefault(b, {}).setdefault(a, 0.0)
        flow = 0.0
        while True:
            came, queue = {source: source}, deque([source])
            while queue and target not in came:
                at = queue.popleft()
                for to, w in left.get(at, {}).items():
                    if w > 1e-12 and to not in came:
                        came[to] = at
                        queue.append(to)
            if target not in came:
                return pd.DataFrame({"flow": [flow]})
            path, at = [], target
            while at != source:
                path.append((came[at], at))
                at = came[at]
            room = min(left[a][b] for a, b in path)
            for a, b in path:
                left[a][b] -= room
                left[b][a] += room
            flow += room

    found = cone.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, "flow double")
    return found.union(spark.createDataFrame([(0.0,)], "flow double")).agg(F.max("flow").alias("flow"))


# results of algorithms as columns of rows

def node_column(rows: DataFrame, result: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the value of their vertex: ``result`` has id and one more column; vertices without one get null."""
    value = next(c for c in result.columns if c != "id")
    return rows.join(result.select(F.col("id").alias(key), F.col(value).alias(name)), key, "left")


def pair_column(rows: DataFrame, result: DataFrame, ends: tuple[str, str], name: str, of: tuple[str, str, str] = ("source", "id", "distance")) -> DataFrame:
    """Rows with the value of their pair of vertices; ``of`` names the result's two ends and its value."""
    a, b, value = of
    return rows.join(result.select(F.col(a).alias(ends[0]), F.col(b).alias(ends[1]), F.col(value).alias(name)), list(ends), "left")


def graph_column(rows: DataFrame, result: DataFrame, name: str, partition: list[str] | None = None) -> DataFrame:
    """Rows with a whole graph's value (one row), or with that of their partition's graph (a row each)."""
    partition = partition or []
    value = next(c for c in result.columns if c not in partition)
    told = result.select(*partition, F.col(value).alias(name))
    return rows.join(told, partition, "left") if partition else rows.crossJoin(F.broadcast(told.limit(1)))


def scoped_edges(edges: DataFrame, source: DataFrame | None = None, target: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Tier (BB, BF, FB or FF: bound or free source and target) and the edges that an algorithm with these ends can use."""
    tier = ("F" if source is None else "B") + ("F" if target is None else "B")
    return tier, edges if tier == "FF" else graph.trim_reachable(edges, source, target)
