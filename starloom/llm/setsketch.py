"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, verified on full sets.

A set's register i is ``floor(1 - log_b(x_i))``, where x_i is the minimum of one
exponential variate per element: minima on an exponentially spaced scale, cut off
at the ends.  Registers of a union are the element-wise maxima, and equal
registers are the likelier the more two sets share.

1. Every document gets its set size, a 128-bit fingerprint of the set, and registers.
2. Documents with equal sets form a class, which is one node from here on.
3. Nodes that agree on a whole band of registers share a bucket.  Small buckets give
   all their pairs; a pair's Jaccard similarity is estimated from its register
   comparison counts and set sizes by maximum likelihood, pairs far below the
   threshold go, and the others are compared on their full sets.
4. In large buckets every member is compared with a leader on its full set, and what
   that leaves open is found from the members' differences (see ``frames``): no pair
   that shares a bucket is lost, and no group is squared.
5. Components of the links come from alternating large-star and small-star steps on
   DataFrames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .common import drop_kept, drop_path, gram_hashes, like, lower_words, mix, shared_path, small_batches, steps, text_column, written

REGISTERS, BAND, BASE, RATE, TOP = 112, 4, 1.02, 20.0, 4094
#: Buckets up to this size give all their pairs.
SMALL_BUCKET = 24
#: Bits of the sieve of documents whose full sets are wanted.
SIEVE_BITS = 26
_seeds = np.random.default_rng(77).integers(1, 2**63, (2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_bounds(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 place of each row's shingles among the places of all words."""
    first, end = rows[:-1], rows[1:] - (k - 1)
    return first, np.maximum(first, end)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int):
    """For each row the sorted distinct hashes of its k-word shingles (fewer words: the whole sequence; none: empty)."""
    words, rows = lower_words(raw, off)
    grams = gram_hashes(words, k)
    first, end = shingle_bounds(rows, k)
    for i in range(len(off) - 1):
        if end[i] > first[i]:
            yield np.unique(grams[first[i] : end[i]])
        elif rows[i + 1] > rows[i]:
            yield gram_hashes(words[rows[i] : rows[i + 1]], int(rows[i + 1] - rows[i]))
        else:
            yield np.empty(0, np.uint64)


def registers_of(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of the sets that begin at ``starts`` in ``grams`` (none empty)."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        low = np.minimum.reduceat(grams * _seeds[0, i] + _seeds[1, i], starts)
        u = (low.astype(np.float64) + 0.5) / 2.0**64
        x = -np.log1p(-u) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1)
    return out


def fingerprints(sets: list[np.ndarray], full: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two sums of mixed elements for each set (0 for empty ones); ``full`` are the places of the others, joined in ``grams``."""
    f = np.zeros((2, len(sets)), np.int64)
    if len(full):
        f[0, full] = np.add.reduceat(mix(grams), starts).view(np.int64)
        f[1, full] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
    return f


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, places of sets that aren't empty, all their elements, and where each begins."""
    n = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(n)
    grams = np.concatenate([sets[x] for x in full]) if len(full) else np.empty(0, np.uint64)
    return n, full, grams, (np.cumsum(n[full]) - n[full])


def sketches(docs: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """key, n (set size), f1, f2 (fingerprint), p1, p2 (the registers' lowest bits), registers (binary, null for the empty set)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches):
        drop_kept()
        for batch in batches:
            for i, j, raw, off in steps(text_column(batch)):
                sets = list(shingle_sets(raw, off, k))
                n, full, grams, starts = joined(sets)
                f = np.zeros((4, j - i), np.int64)
                f[:2] = fingerprints(sets, full, grams, starts)
                regs = [None] * (j - i)
                if len(full):
                    r = registers_of(grams, starts)
                    low = np.zeros((len(full), 128), np.uint8)
                    low[:, :REGISTERS] = r & 1
                    f[2:, full] = np.packbits(low, axis=1).view(np.int64).T
                    for at, row in zip(full, r, strict=True):
                        regs[at] = row.tobytes()
                ids = like(batch.slice(i, j - i), key)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), *(pa.array(x) for x in f), pa.array(regs, pa.binary())], [key, "n", "f1", "f2", "p1", "p2", "registers"])

    fields = [T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2", "p1", "p2")), T.StructField("registers", T.BinaryType())]
    return docs.select(key, "text").mapInArrow(run, T.StructType(fields))


def band_rows(nodes: DataFrame) -> DataFrame:
    """bucket (hash of a band's number and registers), id, n, p1, p2: a row for every band of each node."""
    band = F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band")
    rows = nodes.select(band, "registers", "id", "n", "p1", "p2")
    return rows.select(F.xxhash64("band", F.expr(f"substring(registers, band * {2 * BAND} + 1, {2 * BAND})")).alias("bucket"), "id", "n", "p1", "p2")


def estimated_jaccard(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The J of highest likelihood, on a grid, for pairs with ``more`` registers of a above b's and ``less`` below."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    ll = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), ll.argmax(1)]


def _kept_pairs(batches, fits):
    drop_kept()
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.slice(i, 2000)
            ok = fits(part)
            yield pa.RecordBatch.from_arrays([like(part, "a").filter(pa.array(ok)), like(part, "b").filter(pa.array(ok))], ["a", "b"])


def likely(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is ``least`` at least; ra, rb, na, nb are their registers and sizes."""

    def fits(part):
        a, b = (np.frombuffer(b"".join(like(part, c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        na, nb = (like(part, c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
        return estimated_jaccard((a > b).sum(1), (a < b).sum(1), na, nb) >= least

    return pairs.mapInArrow(lambda it: _kept_pairs(it, fits), pairs.select("a", "b").schema)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets (sa, sb: sorted 64-bit hashes) have 100 * intersection >= percent * union."""

    def fits(part):
        out = np.zeros(len(part), bool)
        for i, (x, y) in enumerate(zip(like(part, "sa"), like(part, "sb"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return out

    return pairs.mapInArrow(lambda it: _kept_pairs(it, fits), pairs.select("a", "b").schema)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, key: str) -> DataFrame:
    """id and s (the full set as binary) of the nodes in ``wanted`` (id, rep, n, f1, f2).

    The texts stay where they are: a bit sieve of a fixed size (2 ** SIEVE_BITS, made of
    at most 2 ** SIEVE_BITS / 64 rows) tells the documents that may be wanted, by key.
    """
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - SIEVE_BITS)
    words = wanted.select(hashed("rep").alias("h")).groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    sieve[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        drop_kept()
        bits = shared.value
        for batch in batches:
            at = like(batch, "_h").to_numpy(zero_copy_only=False)
            hit = pa.array((bits[at >> 6] >> (at & 63)) & 1 > 0)
            batch = pa.RecordBatch.from_arrays([like(batch, c).filter(hit) for c in (key, "text")], [key, "text"])
            for i, j, raw, off in steps(text_column(batch)):
                sets = list(shingle_sets(raw, off, k))
                n, full, grams, starts = joined(sets)
                f = fingerprints(sets, full, grams, starts)
                yield pa.RecordBatch.from_arrays([like(batch.slice(i, j - i), key), pa.array(n), pa.array(f[0]), pa.array(f[1]), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "n", "f1", "f2", "s"])

    longs = [T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")]
    known = docs.filter(F.col(key).isNotNull()).select(key, "text", hashed(key).alias("_h"))
    found = known.mapInArrow(run, T.StructType([T.StructField("rep", docs.schema[key].dataType), *longs, T.StructField("s", T.BinaryType())]))
    return found.join(wanted.select("id", "rep", "n", "f1", "f2"), ["rep", "n", "f1", "f2"]).select("id", "s").dropDuplicates(["id"])


def low_bits(percent: int) -> int:
    """In how many of the registers' low bits two sets of that similarity may differ (five deviations above the mean)."""
    p = (1 - percent / 100) / 2
    return int(REGISTERS * p + 5 * (REGISTERS * p * (1 - p)) ** 0.5) + 1


def alike(percent: int):
    """Sizes and low bits (n, p1, p2 and xn, x1, x2) that sets of that similarity have."""
    return F.expr(f"bit_count(p1 ^ x1) + bit_count(p2 ^ x2) <= {low_bits(percent)}") & (F.least("n", "xn") * 100 >= F.greatest("n", "xn") * percent)


def bucket_pairs(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b that may be alike in small buckets of rows (bucket, id, n, p1, p2), and (bucket, id, size) of large ones."""
    sums = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    joined_ = rows.join(sums, "bucket")
    small = joined_.filter(F.col("size") <= SMALL_BUCKET).select("bucket", "id", "n", "p1", "p2")
    other = small.select(F.col("bucket").alias("there"), F.col("id").alias("x"), F.col("n").alias("xn"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    exact = small.join(other, [F.col("bucket") == F.col("there"), F.col("id") < F.col("x"), alike(percent)]).select(F.col("id").alias("a"), F.col("x").alias("b"))
    return exact, joined_.filter(F.col("size") > SMALL_BUCKET).select("bucket", "id", "size")


class Scratch:
    """Intermediate tables in the shared folder; ``drop`` deletes them."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())


#: Edges from which on ``components`` writes each step's smallest neighbours.
MANY_EDGES = 1_000_000


def components(edges: DataFrame, kept) -> DataFrame:
    """(id, root): for each id in the edges (a, b) the smallest id it is connected with.

    Alternates large-star and small-star steps until the edges are stars; each
    round is written to the shared folder, and so are the smallest neighbours where
    edges are many, so that Spark can split the join of an id with very many
    neighbours.  ``kept`` writes the result.
    """
    spark = edges.sparkSession
    now = Scratch(spark)
    table = now(edges.filter("a <> b").distinct(), "components")
    n = table.count()
    while True:
        after = Scratch(spark)
        step = now if n >= MANY_EDGES else lambda df, label: df
        both = table.select("a", "b").union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = step(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "smallest")
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b")
        # small star: each larger end keeps its smallest neighbour, and its other smaller neighbours move there
        down = step(large.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "large-star")
        least = step(down.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"))
        table = after(moved.filter("a <> b").distinct(), "components")
        now.drop()
        now = after
        n = table.count()
        # done when every edge leads from a component's smallest id to one that has no other edge
        ends = table.select(F.col("b").alias("id"), F.lit(1).alias("low")).union(table.select("a", F.lit(0)))
        if ends.groupBy("id").agg(F.sum("low").alias("n"), F.min("low").alias("low")).filter("n > low").isEmpty():
            both = table.select(F.col("b").alias("id"), F.col("a").alias("root")).union(table.select("a", "a"))
            roots = kept(both.groupBy("id").agg(F.min("root").alias("root")), "roots")
            now.drop()
            return roots


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", repeats: bool = True) -> DataFrame:
    """key, n_shingles, component_id (smallest id connected by links), kept (is that id).

    Links: 100 * |A & B| >= percent * |A | B| on the sets of distinct k-word
    shingles of the lower-cased text.  A text with fewer words is one shingle;
    null, empty and wordless texts have the empty set and link with nothing.  Rows
    that repeat an id are one document: each gets its own n_shingles and the common
    component, with the links of all its texts (``repeats=False`` says that there are
    no such rows).  Rows with a null id come back unlinked (component null, kept).
    An empty table gives an empty result; columns besides key and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(key, "text")
    lasting, scratch = Scratch(spark), Scratch(spark)
    base = lasting(sketches(docs, k, key), "sketches")
    real = base.filter(F.col("n") > 0).filter(F.col(key).isNotNull())
    same = ["n", "f1", "f2"]  # equal sets have equal registers
    classes = real.groupBy(*same).agg(F.min(key).alias("rep"), *(F.first(c).alias(c) for c in ("p1", "p2", "registers")))
    nodes = scratch(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "nodes")

    pairs, large = bucket_pairs(band_rows(nodes), percent)
    pairs = scratch(pairs.distinct(), "pairs")
    large = scratch(large, "large")
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("registers").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    guess = scratch(likely(pairs.join(side("a"), "a").join(side("b"), "b"), percent / 100 - 0.17), "likely")
    grouped = scratch(frames.led(large, scratch), "frames")
    asked = guess.select(F.col("a").alias("id")).union(guess.select("b")).union(grouped.select("id")).union(grouped.select("lead")).distinct()
    sets = scratch(full_sets(docs, nodes.join(asked, "id"), k, key), "sets")
    of = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    links = scratch(confirmed(guess.join(of("a"), "a").join(of("b"), "b"), percent), "links")
    if repeats:
        links = links.union(ties(real, nodes, key))
    diff = scratch(frames.differences(grouped, sets, percent, scratch), "differences")
    links = links.union(frames.near_leader(diff, percent))
    if not diff.isEmpty():
        diff = frames.recentred(diff, sets, percent, scratch)
        links = links.union(frames.near_leader(diff, percent))
        links = scratch(links.union(frames.gathered(diff, sets, percent, scratch)), "links")
        links = links.union(frames.across(diff, components(links, scratch), percent, scratch))
    links = scratch(links, "links")
    roots = components(links, scratch)
    reps = scratch(roots.join(nodes.select("id", "rep"), "id").groupBy("root").agg(F.min("rep").alias("component")), "names")
    named = roots.join(reps, "root").select("id", "component")
    of_class = lasting(nodes.join(named, "id", "left").select(*same, F.coalesce("component", "rep").alias("component")), "classes")
    scratch.drop()
    out = base.select(key, *same).join(of_class, same, "left")
    component = F.when((F.col("n") > 0) & F.col(key).isNotNull(), F.col("component")).otherwise(F.col(key))
    return out.select(key, F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that of the smallest id, null ids last.

    Every row is a document of its own here, so rows that repeat an id, or have none, are
    linked by their texts alone, and of equal rows one stays.  Rows with null, empty or
    wordless texts all stay.  All columns come back.
    """
    names = docs.columns
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(names))), "numbered")
    at = f"_{names.index(key)}"
    me = F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("id"), F.col("_row").alias("row"))
    texts = numbered.select(me.alias("key"), F.col(f"_{names.index('text')}").alias("text"))
    gone = near_duplicates(texts, k, percent, "key", repeats=False).filter(~F.col("kept")).select(F.col("key.row").alias("_row"))
    return numbered.join(gone, "_row", "left_anti").select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))


def ties(real: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Links (a, b) between the classes of the texts that share an id."""
    me = F.struct("n", "f1", "f2")
    many = real.groupBy(key).agg(F.min(me).alias("lo"), F.max(me).alias("hi")).filter("lo <> hi").select(key)
    if many.isEmpty():
        return real.sparkSession.createDataFrame([], "a bigint, b bigint")
    at = real.join(many, key).select(key, "n", "f1", "f2").join(nodes.select("id", "n", "f1", "f2"), ["n", "f1", "f2"]).select(key, "id")
    return at.join(at.groupBy(key).agg(F.min("id").alias("a")), key).filter("a <> id").select("a", F.col("id").alias("b")).distinct()
