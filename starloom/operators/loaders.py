"""Fact loaders and surrogate-key resolution as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed
from .numbering import numbered
from .scd import same_key


def with_snapshot_date(rows: DataFrame, date: str, column: str = "snapshot_date") -> DataFrame:
    """Periodic snapshot: the rows as of a date."""
    return rows.withColumn(column, F.lit(date).cast("date"))


def accumulate(target: DataFrame, batch: DataFrame, key: list[str], milestones: list[str], first_wins: bool = False) -> DataFrame:
    """Accumulating snapshot: new keys come in, known ones get milestones that the batch has (or that they lack)."""
    j = target.alias("t").join(batch.alias("b"), same_key(key, "t", "b"), "left")
    pick = lambda c: F.coalesce(f"t.{c}", f"b.{c}") if first_wins else F.coalesce(f"b.{c}", f"t.{c}")
    old = j.select(*((pick(c) if c in milestones else F.col(f"t.{c}")).alias(c) for c in target.columns))
    new = batch.alias("b").join(target.alias("t"), same_key(key, "b", "t"), "left_anti")
    return old.unionByName(new, allowMissingColumns=True).select(*target.columns)


def cumulate(yesterday: DataFrame, today: DataFrame, key: str, measures: list[str], period: str, history: str = "seasons") -> DataFrame:
    """Cumulative table: history grows by today's struct; is_active and years_since_last_active follow."""
    j = yesterday.alias("y").join(today.alias("t"), F.col(f"y.{key}") == F.col(f"t.{key}"), "full")
    here = F.col(f"t.{key}").isNotNull()
    kind = yesterday.schema[history].dataType.simpleString()
    old = F.coalesce(f"y.{history}", F.array().cast(kind))
    entry = F.array(F.struct(*(F.col(f"t.{m}").alias(m) for m in measures), F.lit(period).alias("period"))).cast(kind)
    return j.select(
        F.coalesce(f"t.{key}", f"y.{key}").alias(key),
        F.when(here, F.concat(old, entry)).otherwise(old).alias(history),
        here.alias("is_active"),
        F.when(here, F.lit(0)).otherwise(F.coalesce("y.years_since_last_active", F.lit(0)) + 1).alias("years_since_last_active"),
    )


def bitmask(rows: DataFrame, key: str, dates: str, reference: str, window: int = 32, name: str = "mask") -> DataFrame:
    """Bit window-1 is the reference day, lower bits the days before; days outside the window don't count."""
    ago = F.datediff(F.lit(reference).cast("date"), F.to_date("_d"))
    days = rows.select(key, F.explode_outer(dates).alias("_d")).withColumn("_ago", ago)
    bit = F.when((F.col("_ago") >= 0) & (F.col("_ago") < window), F.expr(f"shiftleft(1L, {window - 1} - _ago)")).otherwise(F.lit(0).cast("bigint"))
    return days.groupBy(key).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")).alias(name))


def active_days(mask: str, days: int, window: int = 32) -> Column:
    """How many of the last ``days`` days are set."""
    return F.bit_count(F.shiftright(F.col(mask), window - days))


def array_metric(rows: DataFrame, key: str, value: str, day: str, month_start: str, slots: int = 31, name: str = "metric") -> DataFrame:
    """One array a key with the day's sum at its offset from the month's start (0 elsewhere)."""
    off = F.datediff(F.to_date(day), F.lit(month_start).cast("date"))
    sums = rows.withColumn("_o", off).filter((F.col("_o") >= 0) & (F.col("_o") < slots)).groupBy(key, "_o").agg(F.sum(value).alias("_v"))
    maps = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_o", "_v"))).alias("_m"))
    return maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias(name))


def edge_projection(facts: DataFrame, subject: str, obj: str, properties: list[str] | None = None) -> DataFrame:
    """Each fact is an edge."""
    return facts.select(F.col(subject).alias("subject_id"), F.col(obj).alias("object_id"), *(properties or []))


#: Of a self-join: facts and pairs that a task gets, rows of a key that stay together, rows for which a task is worth starting.
TASK_FACTS, TASK_PAIRS, BLOCK, LEAST = 400_000, 1_000_000, 1_000, 10_000


def self_join_edges(facts: DataFrame, subject: str, via: str, properties: list[str]) -> DataFrame:
    """Pairs of subjects that share a key, smaller first, properties summed over both sides and all shared keys.

    Facts are added up by (key, subject) first; the pairs of a key are the result itself.
    The facts of each key are counted beforehand (a job of its own), and as many tasks are
    made as the facts and pairs need, so that what one task holds doesn't grow with the
    input or depend on the session's number of partitions.  Keys of more than BLOCK facts
    are dealt out by blocks of subjects, a task for two of them.
    """
    known = facts.select(via, subject, *properties).filter(F.col(via).isNotNull() & F.col(subject).isNotNull())
    of_key = known.groupBy(via).agg(F.count("*").alias("_n"))
    large, n = F.col("_n") > BLOCK, F.col("_n")
    rows, pairs, others = (int(v or 0) for v in of_key.agg(F.sum(F.when(~large, n)), F.sum(F.when(~large, F.expr("_n * (_n - 1) div 2"))), F.sum(F.when(large, n))).first())
    keys = F.broadcast(of_key.filter(large).select(via))
    rest = known.join(keys, via, "left_anti") if others else known
    sums = [F.sum(p).alias(p) for p in properties]
    own = _dealt(rest, [via], _tasks(facts, rows, pairs)).groupBy("_part", via, subject).agg(*sums)
    found = _pairs(own, own, [via], subject, properties)
    if others:
        tasks = _tasks(facts, others, 0)
        # the facts of one subject are added up where they are dealt from, before they meet
        apart = known.join(keys, via, "left_semi").withColumn("_from", F.spark_partition_id()).repartition(tasks, via, subject, "_from").groupBy(via, subject, "_from").agg(*sums)
        apart = checkpointed(apart.repartition(tasks, via, subject).groupBy(via, subject).agg(*(F.sum(p).cast(own.schema[p].dataType).alias(p) for p in properties)), "edges")
        blocks = apart.groupBy(via).agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(n / BLOCK))
        rows, more = (int(v or 0) for v in blocks.agg(F.sum(n * F.col("_blocks")), F.sum(F.expr("_n * (_n - 1) div 2"))).first())
        each = apart.join(F.broadcast(blocks.select(via, "_blocks")), via).withColumn("_own", F.pmod(F.xxhash64(subject), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        cell, tasks = [via, "_x", "_y"], _tasks(facts, rows, more)
        left, right = (_dealt(each.withColumns({"_x": F.col(x), "_y": F.col(y)}), cell, tasks).select("_part", *cell, subject, *properties) for x, y in (("_own", "_other"), ("_other", "_own")))
        found, pairs = found.unionByName(_pairs(left, right, cell, subject, properties)), pairs + more
    met = found.repartition(_tasks(facts, 0, pairs), "subject_id", "object_id").groupBy("subject_id", "object_id")
    return met.agg(*(F.sum(p).cast(found.schema[p].dataType).alias(p) for p in properties))


def _tasks(facts: DataFrame, rows: int, pairs: int) -> int:
    """As many as facts and pairs need, in whole rounds of those that run at once; of small inputs, less than a round."""
    few = max(1, min(facts.sparkSession.sparkContext.defaultParallelism, -(-max(rows, pairs) // LEAST)))
    return -(-max(1, -(-rows // TASK_FACTS), -(-pairs // TASK_PAIRS)) // few) * few


def _dealt(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Rows in the partition whose number is in _part, so that joins and groups by _part and more stay in it."""
    return rows.withColumn("_part", F.pmod(F.hash(*keys), F.lit(tasks))).repartitionById(tasks, F.col("_part"))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], subject: str, properties: list[str]) -> DataFrame:
    """Pairs within a key, summed in each partition."""
    on = F.col(f"a.{subject}") < F.col(f"b.{subject}")
    for k in ["_part", *keys]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    by = [F.col("a._part"), F.col(f"a.{subject}").alias("subject_id"), F.col(f"b.{subject}").alias("object_id")]
    return left.alias("a").join(right.alias("b"), on).groupBy(*by).agg(*(F.sum(F.col(f"a.{p}") + F.col(f"b.{p}")).alias(p) for p in properties)).drop("_part")


def resolve(facts: DataFrame, dim: DataFrame, pairs: list[tuple[str, str]], sk: str, name: str, at: str | None = None) -> DataFrame:
    """Add the surrogate key: the current row's, or with ``at`` (a column) the version's valid then.  Keys compare as text."""
    cond = F.lit(True)
    for f, d in pairs:
        cond = cond & (F.col(f"f.{f}").cast("string") == F.col(f"d.{d}").cast("string"))
    if at is None:
        d = dim.filter("is_current")
    else:
        d = dim
        cond = cond & (F.col("d.valid_from") <= F.col(f"f.{at}")) & (F.col("d.valid_to").isNull() | (F.col("d.valid_to") > F.col(f"f.{at}")))
    return facts.alias("f").join(d.alias("d"), cond, "left").select("f.*", F.col(f"d.{sk}").alias(name))


def infer_members(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, sk: str, as_of: str) -> DataFrame:
    """The dimension with inferred rows for keys that only facts have, numbered on in key order."""
    missing = facts.select(F.col(fact_key).alias(dim_key)).filter(F.col(dim_key).isNotNull()).distinct().join(dim.select(dim_key), dim_key, "left_anti")
    top = dim.agg(F.coalesce(F.max(sk), F.lit(0)).alias("_top"))
    kind = {f.name: f.dataType for f in dim.schema.fields}
    given = {sk: (F.col("_top") + F.col("_n")).cast(kind[sk]), dim_key: F.col(dim_key), "is_current": F.lit(True), "is_inferred": F.lit(True), "valid_from": F.lit(as_of).cast("timestamp_ntz")}
    new = numbered(missing, [dim_key], "_n").crossJoin(F.broadcast(top)).select(*((given[c] if c in given else F.lit(None)).cast(kind[c]).alias(c) for c in dim.columns))
    return dim.unionByName(new)


def upsert(target: DataFrame, batch: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Last wins: batch rows replace those of the target with the same key."""
    from .scd import deduplicated

    b = deduplicated(batch, key, order) if order else batch
    return target.alias("t").join(b.alias("b"), same_key(key, "t", "b"), "left_anti").unionByName(b.select(*target.columns))
