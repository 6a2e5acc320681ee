"""Trees held as materialised paths ('/1/5/9/'), and dimensions made without input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..storage import checkpointed


def build_path(*ids: Column) -> Column:
    """The path of ids from the root down."""
    return F.concat(F.lit("/"), F.concat_ws("/", *(i.cast("string") for i in ids)), F.lit("/"))


def closure(tree: DataFrame, key: str, path: str) -> DataFrame:
    """(ancestor, descendant, depth), each node its own ancestor at depth 0; a row makes as many as its level, without a join."""
    ids = F.filter(F.split(path, "/"), lambda s: s != "")
    rows = tree.select(F.col(key).alias("descendant"), F.size(ids).alias("_n"), F.posexplode(ids).alias("_at", "ancestor"))
    return rows.select("ancestor", "descendant", (F.col("_n") - 1 - F.col("_at")).cast("bigint").alias("depth"))


def adjacency_closure(nodes: DataFrame, key: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """``closure`` of a tree held as parent keys: one join a level, until no node has a further ancestor.

    ``max_depth`` leaves out ancestors further up.  Without it a cycle, which never ends, is an error.
    """
    up = checkpointed(nodes.select(F.col(key).alias("node"), F.col(parent).alias("above")).filter("above is not null"))
    level = checkpointed(nodes.select(F.col(key).alias("ancestor"), F.col(key).alias("descendant"), F.lit(0).cast("bigint").alias("depth")))
    out, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = checkpointed(level.join(up, F.col("ancestor") == F.col("node")).select(F.col("above").alias("ancestor"), "descendant", F.lit(depth).cast("bigint").alias("depth")))
        if level.isEmpty():
            break
        if max_depth is None and not level.filter("ancestor = descendant").isEmpty():
            raise SchemaError("the parent keys have a cycle")
        out = out.union(level)
    return out


def closure_rollup(facts: DataFrame, links: DataFrame, on: str, nodes: DataFrame, value: Column) -> DataFrame:
    """(ancestor, total) of ``value`` at and below each of ``nodes`` (ancestor), from closure rows; facts are summed by node first."""
    sums = facts.groupBy(F.col(on).alias("descendant")).agg(value.alias("_v"))
    wanted = links.join(nodes.select("ancestor"), "ancestor", "left_semi")
    return wanted.join(sums, "descendant").groupBy("ancestor").agg(F.sum("_v").alias("total"))


def rollup(facts: DataFrame, tree: DataFrame, on: str, key: str, path: str, level: int, value: Column) -> DataFrame:
    """ancestor and total of ``value`` below each node of a level (0: the root); facts are summed by node before they meet the tree."""
    sums = facts.groupBy(F.col(on).alias(key)).agg(value.alias("_v"))
    ids = F.filter(F.split(path, "/"), lambda s: s != "")
    return sums.join(tree.select(key, F.get(ids, F.lit(level)).alias("ancestor")), key).filter("ancestor is not null").groupBy("ancestor").agg(F.sum("_v").alias("total"))


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a day from first to last; Monday is weekday 0, weeks are ISO weeks."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_value")
    d = F.col("date_value")
    whole = {"year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "week_of_year": F.weekofyear(d), "day_of_week": F.weekday(d), "day_of_month": F.dayofmonth(d)}
    names = {"month_name": F.date_format(d, "MMMM"), "day_name": F.date_format(d, "EEEE"), "is_weekend": F.weekday(d) >= 5}
    return spark.range(1).select(day).select("date_value", *(c.cast("bigint").alias(n) for n, c in whole.items()), *(c.alias(n) for n, c in names.items()))


def time_dimension(spark: SparkSession, bins: list[tuple[str, int]]) -> DataFrame:
    """One row a minute; ``bins`` are (name, first hour), ascending; hours before the first bin have the last one's name."""
    hour = F.floor(F.col("id") / 60)
    name = reduce(lambda out, b: F.when(hour >= b[1], b[0]).otherwise(out), bins, F.lit(bins[-1][0]))
    return spark.range(1440).select(F.col("id").alias("minute_of_day"), hour.alias("hour"), (F.col("id") % 60).alias("minute"), name.alias("time_of_day"))


def junk_dimension(spark: SparkSession, flags: dict[str, list]) -> DataFrame:
    """Every combination of the flags' values; they are few by declaration."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in flags.items()]
    return reduce(DataFrame.crossJoin, frames)


def junk_spec(name: str, **flags: list):
    """A named junk dimension: a class whose ``rows(spark)`` are all combinations, with a key, and whose ``flags`` they come from."""

    def rows(spark: SparkSession) -> DataFrame:
        """id (from 1, in the order of the flags' values) and the flags."""
        out, sizes = junk_dimension(spark, flags), [len(v) for v in flags.values()]
        place = F.lit(0)
        for (flag, values), _ in zip(flags.items(), sizes, strict=True):
            place = place * len(values) + F.array_position(F.array(*(F.lit(v) for v in values)), F.col(flag)) - 1
        return out.select((place + 1).cast("bigint").alias("id"), *flags)

    return type(name, (), {"flags": flags, "rows": staticmethod(rows), "__doc__": f"Junk dimension of {', '.join(flags)}."})


class Tree:
    """A hierarchy that answers alike whatever it is held as: parent keys, closure rows or materialised paths."""

    def __init__(self, nodes: DataFrame, key: str, *, parent: str | None = None, path: str | None = None, links: DataFrame | None = None):
        if sum(x is not None for x in (parent, path, links)) != 1:
            raise SchemaError("a tree is held as parent keys, as paths or as closure rows: name one")
        self.nodes, self.key = nodes, key
        self.strategy = "adjacency" if parent is not None else "path" if path is not None else "closure"
        self._links = links if links is not None else adjacency_closure(nodes, key, parent) if parent is not None else closure(nodes, key, path)

    def links(self) -> DataFrame:
        return self._links

    def ancestors(self, of: DataFrame, max_depth: int | None = None) -> DataFrame:
        """(ancestor, descendant, depth) above the nodes in ``of`` (descendant)."""
        out = self._links.filter("depth > 0").join(of.select("descendant"), "descendant", "left_semi")
        return out if max_depth is None else out.filter(F.col("depth") <= max_depth)

    def descendants(self, of: DataFrame, max_depth: int | None = None) -> DataFrame:
        """(ancestor, descendant, depth) below the nodes in ``of`` (ancestor)."""
        out = self._links.filter("depth > 0").join(of.select("ancestor"), "ancestor", "left_semi")
        return out if max_depth is None else out.filter(F.col("depth") <= max_depth)

    def level(self, n: int) -> DataFrame:
        """(ancestor) nodes of a level, 0 being the roots."""
        return self._links.groupBy(F.col("descendant").alias("ancestor")).agg(F.max("depth").alias("_d")).filter(F.col("_d") == n).select("ancestor")

    def rollup(self, facts: DataFrame, on: str, level: int, value: Column) -> DataFrame:
        """(ancestor, total) at and below each node of a level."""
        return closure_rollup(facts, self._links, on, self.level(level), value)
