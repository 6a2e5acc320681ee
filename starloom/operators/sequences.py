"""Temporal modes and properties over each entity's sequence of states.

``at`` is a total order of an entity's states (a struct of time and id, say).  Each
property is one aggregate of first and last positions, so partial sums are made
before the shuffle and an entity's states never come together in one task.  A null
condition counts as false.  Only entities with states have a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def eventually(p: Column) -> Column:
    """Some state (from the first on; ONCE: from the last back; LIVENESS)."""
    return F.bool_or(_is(p))


def globally(p: Column) -> Column:
    """Every state (SAFETY(bad) is that of the negation)."""
    return F.bool_and(_is(p))


def safety(bad: Column) -> Column:
    return ~F.bool_or(_is(bad))


def until(hold: Column, goal: Column, at: Column) -> Column:
    """Some state meets the goal, and all before the first such hold."""
    met, broken = F.min(F.when(_is(goal), at)), F.min(F.when(~_is(hold), at))
    return met.isNotNull() & (broken.isNull() | (broken >= met))


def since(hold: Column, goal: Column, at: Column) -> Column:
    """Some state meets the goal, and all after the last such hold."""
    met, broken = F.max(F.when(_is(goal), at)), F.max(F.when(~_is(hold), at))
    return met.isNotNull() & (broken.isNull() | (broken <= met))


def response(trigger: Column, answer: Column, at: Column) -> Column:
    """Every triggering state is answered by itself or a later one."""
    asked, told = F.max(F.when(_is(trigger), at)), F.max(F.when(_is(answer), at))
    return asked.isNull() | (told.isNotNull() & (told >= asked))


def persistence(good: Column, at: Column) -> Column:
    """From some state on all are good: on a finite sequence, the last one is."""
    return F.max_by(_is(good), at)


def recurrence(good: Column, bucket: Column) -> Column:
    """Every bucket (a whole number) from the entity's first to its last has a good state."""
    return F.count_distinct(F.when(_is(good), bucket)) == F.max(bucket) - F.min(bucket) + 1


def beside(states: DataFrame, entity: str, p: Column, at: Column, back: bool = False) -> DataFrame:
    """(entity, holds): whether the second state satisfies p (NEXT), or the last but one (``back``: PREVIOUSLY); false without one."""
    s = states.select(entity, _is(p).alias("p"), at.alias("at"))
    edge = s.groupBy(entity).agg((F.max if back else F.min)("at").alias("edge"))
    inner = s.join(edge, entity).withColumn("other", F.when(F.col("at") != F.col("edge"), F.col("at")))
    return inner.groupBy(entity).agg(F.coalesce((F.max_by if back else F.min_by)(F.when(F.col("other").isNotNull(), F.col("p")), "other"), F.lit(False)).alias("holds"))
