"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs come from whole training texts, and all of them go into
the model: its size grows with the input.  A count c is held as its level
1 + floor(log_STEP(c)); the filter has an entry for (n-gram, 1) ... (n-gram, level), and
probing upwards until the first miss gives the level back.

The filter is split by the n-gram's hash into as many blocks as a shuffle has partitions.
Tasks build the blocks where the counts are aggregated, and the driver broadcasts them
in groups of at most ``GROUP`` bytes; with several groups a task scores ``GATHER`` bytes
of texts at a time against one group after another, so that no worker holds more than one
group of each order.

score: sum of log10 P(w | v), with P(w | v) = LAMBDA * count(v w) / count(v) + (1 - LAMBDA) * P(w)
and P(w) = count(w) / (N + 1/2), or 1/2 / (N + 1/2) for a word that the filter lacks.  A count
above stands at the lower end of its level and one below at the upper end, so that what
quantisation loses is lost from the probabilities: those of all words after a word add up
to 1 at most (but for the filter's false answers).

base_score needs exact counts of all words.  Frequent words (``FLOOR`` times the training
tokens or more, at most 1 / FLOOR) are looked up in a broadcast table; the others, of which no word is frequent, are joined
with the table of all counts by the word's hash, so no join key is hot.

Words are known by 64-bit hashes.  Defined results: null text is empty and scores its
end token; a null key is never learned from and not held out; without training
tokens N and V are 0 and every token has count 0 (base_score is then log10(0.1/0.1) = 0 a
token); repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, like, lower_words, mix, row_ids, shared_path, small_batches, steps, text_column

FLOOR, STEP, LAMBDA, PROBES, BITS = 5e-7, 1.5, 0.7, 6, 12
GROUP, GATHER = 32 << 20, 2 << 20
_rng = np.random.default_rng(909)
END, BEGIN, PAIR = (np.uint64(x) for x in _rng.integers(1, 2**63, 3, dtype=np.uint64))


def tokens_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each row's words, the hash before each, and the rows' bounds."""
    words, rows = lower_words(raw, off)
    bounds = rows + np.arange(len(rows))
    out = np.insert(words, rows[1:], END)
    before = np.concatenate([[BEGIN], out[:-1]]) if len(out) else out
    before[bounds[:-1]] = BEGIN
    return out, before, bounds


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix((before ^ PAIR) * np.uint64(0x9E3779B97F4A7C15) + words)


class LogBloom:
    """(key, level) entries in one bit array."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: float):
        self.least = least
        level = 1 + np.floor(np.log(np.maximum(counts, least) / least) / np.log(STEP) + 1e-9).astype(int)
        self.top = int(level.max(initial=0))
        self.bits = np.uint64(max(1024, int(level.sum()) * BITS) | 1)
        self.table = np.zeros(int(self.bits) // 8 + 1, np.uint8)
        for j in range(1, self.top + 1):
            for at in self._places(keys[level >= j], j):
                np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def _places(self, keys: np.ndarray, level: int):
        h = mix(keys + np.uint64(level * 0x632BE59BD9B4E019 % 2**64))
        step = (h >> np.uint64(33)) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) % self.bits

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of the level each key reaches (0 if none)."""
        return middle(reached(self.table, keys, np.full(len(keys), self.bits), np.zeros(len(keys), np.uint64), self.top), self.least)


def reached(table: np.ndarray, keys: np.ndarray, bits: np.ndarray, first: np.ndarray, top: int) -> np.ndarray:
    """The level that each key reaches in its own run of bits, which begins at bit ``first`` of the table."""
    level = np.zeros(len(keys), np.int64)
    live = np.flatnonzero(bits)
    for j in range(1, top + 1):
        if not len(live):
            break
        h, b, f = mix(keys[live] + np.uint64(j * 0x632BE59BD9B4E019 % 2**64)), bits[live], first[live]
        step = (h >> np.uint64(33)) | np.uint64(1)
        for _ in range(PROBES):
            at = f + h % b
            hit = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            live, h, step, b, f = live[hit], h[hit] + step[hit], step[hit], b[hit], f[hit]
        level[live] = j
    return level


def middle(level: np.ndarray, least: float = 1.0) -> np.ndarray:
    return np.where(level > 0, least * STEP ** (level - 0.5), 0.0)


def lower(level: np.ndarray) -> np.ndarray:
    """The least count of a level (0 if none)."""
    return np.where(level > 0, np.ceil(STEP ** (level - 1.0) - 1e-6), 0.0)


def upper(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level (0 if none)."""
    return np.where(level > 0, np.ceil(STEP**level - 1e-6) - 1, 0.0)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The partition, of so many, into which Spark's shuffle deals each key as a bigint."""
    h = np.full(len(keys), 42, np.uint32)
    for shift in (0, 32):
        k = (keys >> np.uint64(shift)).astype(np.uint32) * np.uint32(0xCC9E2D51)
        h ^= ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % blocks


class Group:
    """The blocks from ``low`` up to ``high``, in layers; a block built by several tasks has a part in several layers."""

    def __init__(self, low: int, high: int, parts: list[tuple[int, int, int, bytes]]):
        self.low, self.layers, place = low, [], 0
        self.top = max((top for _, top, _, _ in parts), default=0)
        seen: dict[int, int] = {}
        for b, _, bits, table in parts:
            layer = seen[b] = seen.get(b, -1) + 1
            if layer == len(self.layers):
                self.layers.append((np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)))
            self.layers[layer][0][b - low], self.layers[layer][1][b - low] = bits, place * 8
            place += len(table)
        self.table = np.empty(place, np.uint8)
        place = 0
        for _, _, _, table in parts:
            self.table[place : place + len(table)] = np.frombuffer(table, np.uint8)
            place += len(table)

    def levels(self, keys: np.ndarray, block: np.ndarray) -> np.ndarray:
        level = np.zeros(len(keys), np.int64)
        for bits, first in self.layers:
            level = np.maximum(level, reached(self.table, keys, bits[block - self.low], first[block - self.low], self.top))
        return level


class Held:
    """A log-frequency filter of all counts (h, c), which are dealt by the hash of h, in broadcast groups of blocks."""

    def __init__(self, counted: DataFrame):
        spark = counted.sparkSession
        blocks = self.blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def build(batches):
            got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
            if got:
                h, c = (np.concatenate(x) for x in zip(*got, strict=True))
                block = block_of(h, blocks)
                order = np.argsort(block, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                    if len(own):
                        part = LogBloom(h[own], c[own], 1.0)
                        yield pa.RecordBatch.from_pydict({"b": pa.array([block[own[0]]], pa.int64()), "top": pa.array([part.top], pa.int64()), "bits": pa.array([int(part.bits)], pa.int64()), "bytes": pa.array([len(part.table)], pa.int64()), "held": pa.array([part.table.tobytes()], pa.binary())})

        path, schema = shared_path(spark, "lm-filter"), "b bigint, top bigint, bits bigint, bytes bigint, held binary"
        counted.select("h", "c").mapInArrow(build, schema).write.parquet(path)
        parts = spark.read.schema(schema).parquet(path)
        self.groups, low, size = [], 0, 0
        bounds = []
        for b, n in sorted((r.b, r.n) for r in parts.groupBy("b").agg(F.sum("bytes").alias("n")).collect()):
            if size and size + n > GROUP:
                bounds.append((low, b))
                low, size = b, 0
            size += n
        for low, high in [*bounds, (low, blocks)]:
            t = parts.filter((F.col("b") >= low) & (F.col("b") < high)).select("b", "top", "bits", "held").toArrow()
            rows = list(zip(*(t.column(i).to_pylist() for i in range(4)), strict=True))
            self.groups.append((low, high, spark.sparkContext.broadcast(Group(low, high, rows))))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level each key reaches (0 if none)."""
        block, level = block_of(keys, self.blocks), np.zeros(len(keys), np.int64)
        for low, high, group in self.groups:
            own = np.flatnonzero((block >= low) & (block < high))
            if len(own):
                level[own] = group.value.levels(keys[own], block[own])
                if len(self.groups) > 1:
                    group.__dict__.pop("_value", None)  # the next group takes its place
        return level


def gathered(batches, least: int):
    """Batches put together until they have at least so many bytes."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= least:
            yield kept[0] if len(kept) == 1 else pa.concat_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.concat_batches(kept)


def all_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens_of for a whole batch, cut up step by step."""
    got = [tokens_of(raw, off) for _, _, raw, off in steps(text_column(batch))]
    sizes = np.cumsum([0, *(len(words) for words, _, _ in got)])
    return (*(np.concatenate([x[k] for x in got]) for k in range(2)), np.concatenate([np.zeros(1, np.int64), *(x[2][1:] + n for x, n in zip(got, sizes[:-1], strict=True))]))


def _counted(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """(h, c): counts of all tokens, or of all pairs."""

    def run(batches):
        kept: list[np.ndarray] = []
        size = 0

        def flush():
            h, c = np.unique(np.concatenate(kept), return_counts=True)
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000].astype(np.int64))], ["h", "c"])

        for batch in batches:
            for _, _, raw, off in steps(text_column(batch)):
                words, before, _ = tokens_of(raw, off)
                if pairs:
                    words = pair_hashes(before, words)
                if len(words):
                    kept.append(words)
                    size += len(words)
                if size > 4_000_000:
                    yield from flush()
                    kept, size = [], 0
        if kept:
            yield from flush()

    return docs.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """h and c of at most 1 / FLOOR rows."""
    t = df.toArrow()
    return t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()


class Model:
    def __init__(self, words, tokens: int, distinct: int):
        h, c = words
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.tokens, self.distinct = tokens, distinct

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, -1 for others."""
        if not len(self.h):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.h, words), len(self.h) - 1)
        return np.where(self.h[at] == words, self.c[at], -1)

    def score(self, single: Held, pairs: Held, words: np.ndarray, before: np.ndarray, inverse: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """log10 P of each token; ``distinct`` and ``inverse`` are np.unique of the words."""
        known = single.levels(np.append(distinct, END))
        one, end = upper(known[:-1]), upper(known[-1:])[0]
        alone = (np.where(one > 0, lower(known[:-1]), 0.5) / (self.tokens + 0.5))[inverse]
        at = np.minimum(np.searchsorted(distinct, before), len(distinct) - 1)
        context = np.where(distinct[at] == before, one[at], 0.0)
        context[before == BEGIN] = end  # a text begins as often as it ends
        pair = np.zeros(len(words))
        live = np.flatnonzero((context > 0) & (one > 0)[inverse])
        if len(live):
            different, back = np.unique(pair_hashes(before[live], words[live]), return_inverse=True)
            pair[live] = lower(pairs.levels(different))[back]
        share = np.minimum(pair / np.maximum(context, 1e-9), 1.0)
        return np.log10(np.maximum(np.where(context > 0, LAMBDA * share + (1 - LAMBDA) * alone, alone), 1e-30))


def train(docs: DataFrame, key: str = "doc_id", folds: int = 10) -> tuple[Model, Held, Held, DataFrame]:
    """The model, its filters of words and pairs, and the table (h, c) of all word counts in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter(crc_mod(key, folds) > 0).select("text")
    path = shared_path(spark, "word-counts")
    _counted(known).write.parquet(path)
    counts = spark.read.schema("h bigint, c bigint").parquet(path)
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = _columns(counts.filter(F.col("c") >= max(1.0, FLOOR * tokens)))
    return Model(words, tokens, distinct), Held(counts.repartition("h")), Held(_counted(known, pairs=True)), counts


def lm_scores(docs: DataFrame, key: str = "doc_id", folds: int = 10) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    model, single, pairs, counts = train(docs, key, folds)
    shared = spark.sparkContext.broadcast(model)  # fixed largest size: frequent words
    gather = GATHER if max(len(single.groups), len(pairs.groups)) > 1 else 0

    def run(batches):
        from pyspark import TaskContext

        m, row = shared.value, TaskContext.get().partitionId() << 36
        for part in gathered(batches, gather):
            if part.num_rows:
                words, before, bounds = all_tokens(part)
                distinct, inverse = np.unique(words, return_inverse=True)
                exact = m.exact(distinct)
                base = np.where(exact >= 0, m.base(np.maximum(exact, 0)), 0.0)[inverse]
                frequent = (exact >= 0)[inverse]
                score = m.score(single, pairs, words, before, inverse, distinct)
                doc = row_ids(bounds)
                n = part.num_rows
                sums = [np.bincount(doc, v, n) for v in (base, score)]
                # the other words, once a row, with how often each occurs
                rest = np.flatnonzero(~frequent)
                order = rest[np.lexsort((inverse[rest], doc[rest]))]
                d, w = doc[order], inverse[order]
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(order) else np.empty(0, bool)
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order))).astype(np.int32)
                lists = np.concatenate([[0], np.cumsum(np.bincount(d[at], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        like(part, key), pa.array(np.arange(row, row + n)), pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(np.bincount(doc[frequent], minlength=n).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(distinct[w[at]].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(times)),
                    ],
                    ["key", "row", "n_tokens", "known", "base", "score", "rare", "times"],
                )
                row += n

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, row bigint, n_tokens bigint, known bigint, base double, score double, rare array<bigint>, times array<int>"
    path = shared_path(spark, "lm-scores")
    docs.select(key, "text").mapInArrow(run, schema).write.parquet(path)
    scored = spark.read.schema(schema).parquet(path)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    least = max(1.0, FLOOR * model.tokens)
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.1) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))
    tail = rare.join(counts.filter(F.col("c") < least), "h", "left").groupBy("row").agg(F.sum(F.col("times") * base).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = scored.select("key", "row", "n_tokens", "known", "base", "score").join(tail, "row", "left")
    return out.select(
        F.col("key").alias(key), (F.coalesce(F.crc32(F.col("key").cast("string")) % folds, F.lit(-1)) == 0).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
