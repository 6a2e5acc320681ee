"""Links inside large buckets, from each member's difference to one leader; no pairs of a group are squared.

A bucket's leader is a real set T of t elements.  A member A is held as its missing
elements M = T - A and its extra ones E = A - T.  For two members

    |A & B| = t - |Ma| - |Mb| + c    |A | B| = t + |Ea| + |Eb| - c

with c the number of elements that their differences share.  With s = 100 |M| + p |E|,
the link bound 100 |A & B| >= p |A | B| is

    s_a + s_b - (100 + p) c <= (100 - p) t

1. Members with s <= (100 - p) t are linked with the leader.  Two members with c = 0
   can be linked only if both of them are, so they are in one component then.
2. What is left are pairs of different components, of which one member is not in the
   leader's, that share elements of their differences.  With r elements a member needs a
   partner with s_a + s_b - (100 + p) min(r_a, r_b) <= (100 - p) t, and a link has at least
   so many elements in common that the first ones of both, in any order that is the same
   for all (all but that many, plus n), share n.  Extra elements come first, as most are
   a member's own; members go of whose first ones too few are those of other components'.
3. Of the others' elements those count that members of different components hold.  By
   their number members go as before, and the others meet by their rarest ones.
4. Pairs that meet are decided by the formula on their whole differences.

First the leader gives way to a member nearer to the middle of its frame, and members
outside are gathered around leaders of their own, so that groups inside a bucket become
components by one comparison a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, like

#: Members of a frame that are compared with its leader in one task's group; rounds that gather members outside.
BLOCK, ROUNDS = 1000, 1
#: Frames with fewer members outside get no further leader.
GATHER = 24
#: About so many members of a frame tell its middle (it only chooses leaders: results don't depend on it).
MIDDLE = 200
#: Elements that two linked members share among their first ones (all, if a link needs fewer).
SHARED = 8
#: Bins of s, FINE to the link bound, in which the best partners are kept; the last is open.
BINS, FINE = 1024, 64


def with_score(large: DataFrame) -> DataFrame:
    """``large`` (bucket, id, size) with the sum of the sizes of the id's buckets: the more, the nearer to the middle of a group."""
    return large.join(large.groupBy("id").agg(F.sum("size").alias("score")), "id").select("bucket", "id", "score")


def led(large: DataFrame, kept) -> DataFrame:
    """Distinct (lead, id, score): the members of all large buckets (bucket, id, size), by leader.

    A bucket's own leader is its member of highest score.  Buckets of one group have
    members in common, so a member's best leader is the one of highest score among its
    buckets', and a bucket half of whose members have one best leader takes that (any
    real set can lead): a group's buckets become one frame or a few.
    """
    rows = kept(with_score(large), "scored")
    own = kept(rows.groupBy("bucket").agg(F.max(F.struct("score", "id")).alias("own")), "leads")
    best = kept(rows.join(own, "bucket").groupBy("id").agg(F.max("own").alias("best")), "best")
    votes = rows.join(best, "id").groupBy("bucket", "best").agg(F.count("*").alias("n"))
    most = votes.groupBy("bucket").agg(F.max(F.struct("n", "best")).alias("most"), F.sum("n").alias("all"))
    leads = own.join(most, "bucket").select("bucket", F.when(F.col("most.n") * 2 >= F.col("all"), F.col("most.best.id")).otherwise(F.col("own.id")).alias("lead"))
    return rows.join(kept(leads, "leads"), "bucket").filter("lead <> id").select("lead", "id", "score").distinct()


def led_again(outside: DataFrame, kept) -> DataFrame:
    """Distinct (lead, id, score) of rows (of, id, score): each group's member of highest score leads it, in groups of GATHER or more."""
    leads = outside.groupBy("of").agg(F.max(F.struct("score", "id")).alias("l"), F.count("*").alias("c")).filter(F.col("c") >= GATHER).select("of", F.col("l.id").alias("lead"))
    return outside.join(kept(leads, "leads"), "of").filter("lead <> id").select("lead", "id", "score").distinct()


def differences(frames: DataFrame, sets: DataFrame, percent: int, kept) -> DataFrame:
    """lead, id, score, t, s, d (sorted elements of E, then those of M) for each row of ``frames``; ``sets`` has id and s (sorted hashes)."""
    parts = kept(frames.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "parts")
    own = frames.join(parts, "lead").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    own = own.join(sets, "id")
    of_lead = parts.join(sets.select(F.col("id").alias("lead"), F.col("s").alias("of_lead")), "lead").select("lead", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "of_lead")

    def run(batches):
        drop_kept()
        for batch in batches:
            t, s, d = [], [], []
            for x, y in zip(like(batch, "s"), like(batch, "of_lead"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                extra, missing = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                t.append(len(b))
                s.append(100 * len(missing) + percent * len(extra))
                d.append(np.concatenate([extra, missing]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(like(batch, c) for c in ("lead", "id", "score")), pa.array(t, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["lead", "id", "score", "t", "s", "d"])

    together = own.join(of_lead, ["lead", "block"]).select("lead", "id", "score", "s", "of_lead")
    return together.mapInArrow(run, "lead bigint, id bigint, score bigint, t bigint, s bigint, d array<bigint>")


def recentred(diff: DataFrame, sets: DataFrame, percent: int, kept) -> DataFrame:
    """``diff`` with a leader nearer to the middle for frames of which a part, not most, is outside.

    The middle of a frame has what most members have.  Elements that more than half of
    the differences (of about MIDDLE members) hold lead from the leader to it; the member
    whose difference has most of these and little else is the new leader.
    """
    out = F.sum((F.col("s") > F.col("t") * (100 - percent)).cast("int"))
    frames = diff.groupBy("lead").agg(F.count("*").alias("size"), out.alias("out")).filter("out > 0 and out * 4 < size * 3").select("lead", "size")
    frames = kept(frames, "uneven")
    some = diff.join(frames, "lead").filter(F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / MIDDLE)) == 0).select("lead", "d")
    some = some.join(some.groupBy("lead").agg(F.count("*").alias("of")), "lead").select("lead", "of", F.explode("d").alias("x"))
    most = some.groupBy("lead", "x").agg(F.count("*").alias("c"), F.first("of").alias("of")).filter("c * 2 > of")
    most = kept(most.groupBy("lead").agg(F.collect_list("x").alias("most")), "most")  # twice a mean difference at most
    shared = diff.join(most, "lead").select("lead", "id", "s", F.size(F.array_intersect("d", "most")).alias("shared"))
    worth = F.struct((F.col("s") - F.col("shared") * (100 + percent)).alias("far"), F.col("id").alias("to"))
    moved = shared.groupBy("lead").agg(F.min(worth).alias("w")).select("lead", "w.*").filter("far < 0").select("lead", "to")
    moved = kept(moved, "moved")
    there = diff.join(moved, "lead").filter("id <> to").select(F.col("to").alias("lead"), "id", "score").union(moved.select(F.col("to").alias("lead"), F.col("lead").alias("id"), F.lit(0).cast("bigint").alias("score")))
    new = differences(kept(there.groupBy("lead", "id").agg(F.max("score").alias("score")), "recentred"), sets, percent, kept)
    return kept(diff.join(moved, "lead", "left_anti").unionByName(new), "recentred-differences")


def near_leader(diff: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members with their leaders."""
    return diff.filter(F.col("s") <= F.col("t") * (100 - percent)).select(F.col("lead").alias("a"), F.col("id").alias("b"))


def gathered(diff: DataFrame, sets: DataFrame, percent: int, kept) -> DataFrame:
    """Links of members outside with leaders chosen among them, in ROUNDS rounds."""
    links = None
    for _ in range(ROUNDS):
        outside = diff.filter(F.col("s") > F.col("t") * (100 - percent)).select(F.col("lead").alias("of"), "id", "score")
        frames = kept(led_again(outside, kept), "gathered")
        diff = kept(differences(frames, sets, percent, kept), "gathered-differences")
        links = near_leader(diff, percent) if links is None else links.union(near_leader(diff, percent))
    return links


def _bounded(rows: DataFrame, percent: int, kept) -> DataFrame:
    """Rows (lead, id, root, out, t, s, x: elements) that may have a link by the number of their elements, with ``least``.

    ``least`` is the number of elements that any link of the row has in common with its
    partner; ``out`` says that the row isn't in its leader's component, as one of a pair's has to be.
    """
    limit, weight = F.col("t") * (100 - percent), F.lit(100 + percent)
    live = rows.withColumns({"limit": limit, "r": F.size("x").cast("bigint")})
    live = live.withColumns({"gain": weight * F.col("r") - F.col("s"), "bin": F.least(F.floor(F.col("s") * FINE / F.greatest("limit", F.lit(1))), F.lit(BINS - 1))})
    live = kept(live, "live")
    bins = live.groupBy("lead", "bin").agg(F.max("gain").alias("gain"), F.max(F.when(F.col("out"), F.col("gain"))).alias("of_out"))
    bins = kept(bins.groupBy("lead").agg(F.collect_list(F.struct("bin", "gain", "of_out")).alias("bins")), "bins")  # BINS entries at most
    # a partner's s is at least the lower end of its bin; for a member of the leader's component it is one outside
    edge = lambda b: F.floor(b["bin"] * F.col("limit") / FINE)
    fits = lambda b: (F.when(F.col("out"), b["gain"]).otherwise(b["of_out"]) >= F.col("s") - F.col("limit")) & (edge(b) <= F.col("limit") + F.col("gain"))
    near = live.join(bins, "lead").withColumn("near", F.array_min(F.transform(F.filter("bins", fits), edge))).filter("near is not null")
    near = near.withColumn("near", F.when(F.col("out"), F.col("near")).otherwise(F.greatest("near", F.col("limit") + 1)))
    least = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("near") - F.col("limit")) / weight))
    return near.withColumn("least", least).filter("r >= least").select("lead", "id", "root", "t", "s", "limit", "r", "out", "least", "x")


def _first(n: int) -> Column:
    """The first elements of a row of ``_bounded``, of which a link's two members share ``n``, or all that they have in common."""
    return F.explode(F.slice("x", F.lit(1), (F.col("r") - F.col("least") + n).cast("int"))).alias("x")


def _pruned(rows: DataFrame, percent: int, kept) -> DataFrame:
    """``_bounded`` rows that may have a link by the elements that other components' members have: with these, rarest first."""
    rows = kept(_bounded(rows, percent, kept), "bounded")
    first = kept(rows.select("lead", "id", "root", "out", _first(SHARED)), "first")
    met = first.groupBy("lead", "x").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("out").alias("out")).filter("lo <> hi and out").select("lead", "x")
    shared = first.join(kept(met, "met"), ["lead", "x"]).groupBy("lead", "id").agg(F.count("*").alias("shared"))
    rows = kept(rows.join(shared, ["lead", "id"]).filter(F.col("shared") >= F.least("least", F.lit(SHARED))).drop("shared"), "meeting")
    each = kept(rows.select("lead", "id", "root", F.explode("x").alias("x")), "elements")
    useful = each.groupBy("lead", "x").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("lead", "x", "c")
    held = each.select("lead", "id", "x").join(kept(useful, "useful"), ["lead", "x"]).groupBy("lead", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda e: e["x"]).alias("x"))
    return _bounded(rows.select("lead", "id", "root", "out", "t", "s").join(held, ["lead", "id"]), percent, kept)


def across(diff: DataFrame, roots: DataFrame, percent: int, kept) -> DataFrame:
    """Links (a, b) between members of a frame that ``roots`` (id, root) doesn't have in one component."""
    placed = diff.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = placed.join(roots.select(F.col("id").alias("lead"), F.col("root").alias("main")), "lead", "left")
    placed = kept(placed.select("lead", "id", "root", (F.col("root") != F.coalesce("main", "lead")).alias("out"), "t", "s", "d"), "placed")
    mixed = kept(placed.groupBy("lead").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("lead"), "mixed")
    rows = placed.select("lead", "id", "root", "out", "t", "s", F.col("d").alias("x")).join(mixed, "lead")
    rows = kept(_pruned(rows, percent, kept), "pruned")
    keys = rows.select("lead", "id", "root", "s", "limit", "r", "out", _first(1))
    keys = kept(keys, "prefixes")
    one = keys.filter("out").select("lead", "x", *(F.col(c).alias(f"{c}_a") for c in ("id", "root", "s", "limit", "r")))
    two = keys.select("lead", "x", *(F.col(c).alias(f"{c}_b") for c in ("id", "root", "s", "r", "out")))
    fits = (F.col("root_a") != F.col("root_b")) & (~F.col("out_b") | (F.col("id_a") < F.col("id_b"))) & (F.col("s_a") + F.col("s_b") - F.col("limit_a") <= F.least("r_a", "r_b") * (100 + percent))
    met = kept(one.join(two, ["lead", "x"]).filter(fits).groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.min("lead").alias("lead")), "met")
    side = lambda c: placed.select("lead", F.col("id").alias(c), "t", F.col("s").alias(f"s{c}"), F.col("d").alias(f"d{c}"))
    both = met.join(side("a"), ["lead", "a"]).join(side("b").drop("t"), ["lead", "b"])
    common = F.size(F.array_intersect("da", "db"))
    return both.filter(F.col("sa") + F.col("sb") - common * (100 + percent) <= F.col("t") * (100 - percent)).select("a", "b")
