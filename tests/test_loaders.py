"""Fact loaders that deal their work out by the size of the input."""

from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from starloom.operators import loaders


def edges(facts):
    """Pairs with their sums, in plain Python."""
    held, out = defaultdict(Counter), Counter()
    for key, subject, q in facts:
        if key is not None and subject is not None:
            held[key][subject] += q
    for own in held.values():
        for a, b in combinations(sorted(own), 2):
            out[a, b] += own[a] + own[b]
    return out


def test_self_join_tasks_stay_small(spark, monkeypatch):
    """However large the input, no task gets more pairs than it should, whatever the session's number of partitions."""
    for name, v in (("TASK_FACTS", 500), ("TASK_PAIRS", 500), ("BLOCK", 20)):
        monkeypatch.setattr(loaders, name, v, raising=False)
    for copies in (1, 4):
        facts = [(k, (k * 7 + i * i) % 400 + 1000 * (k // 500), k % 5 + i) for k in range(500 * copies) for i in range(4)]
        got = loaders.self_join_edges(spark.createDataFrame(facts, "k long, s long, q long"), "s", "k", ["q"])
        at = got.withColumn("_at", F.spark_partition_id()).collect()
        assert {(r.subject_id, r.object_id): r.q for r in at} == edges(facts)
        assert max(Counter(r["_at"] for r in at).values()) <= 1000


def test_self_join_of_frequent_keys(spark, monkeypatch):
    """Keys of many subjects, of many facts of few subjects, of both, nulls, and one pair that most keys share."""
    for name, v in (("TASK_FACTS", 500), ("TASK_PAIRS", 500), ("BLOCK", 20)):
        monkeypatch.setattr(loaders, name, v, raising=False)
    facts = [("many", i, i % 7) for i in range(150)] + [("few", i % 3, 1) for i in range(300)] + [("both", i % 90, i % 4) for i in range(400)]
    facts += [(f"k{k}", s, 1) for k in range(300) for s in (1, 2)] + [(None, 5, 1), (None, 6, 1), ("k1", None, 9), ("k1", 3, 2)]
    frame = spark.createDataFrame(facts, "k string, s long, q long").withColumn("d", F.col("q").cast("decimal(9,2)"))
    got = loaders.self_join_edges(frame, "s", "k", ["q", "d"])
    assert got.dtypes == [("subject_id", "bigint"), ("object_id", "bigint"), ("q", "bigint"), ("d", "decimal(30,2)")]
    rows = got.collect()
    assert len(rows) == len({(r.subject_id, r.object_id) for r in rows})
    assert {(r.subject_id, r.object_id): r.q for r in rows} == {(r.subject_id, r.object_id): int(r.d) for r in rows} == edges(facts)


def test_self_join_of_nothing(spark):
    assert loaders.self_join_edges(spark.createDataFrame([], "k long, s long, q long"), "s", "k", ["q"]).collect() == []
