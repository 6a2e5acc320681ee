"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of lower-cased words.  The CGK walk copies the word
under its pointer at every step and moves on or stays, as a random function of the
step and that word says; sequences at a small edit distance get copies at a small
Hamming distance.  A key samples a few steps of the walk; several walks with several
samples each make a miss unlikely.

Windows start at every STRIDE-th word of a document; items are also indexed from
their first STRIDE words on, so that each occurrence meets a window it is aligned
with.  The walk over the first 2m words takes the steps of the walk over the first
m, so that one walk serves windows of all item size classes.  Windows whose key
meets an item's key are candidates.

Walks cover an item's first words only and lose occurrences at random, so exact seeds
along the whole item complete them: k edits leave at most k + 1 unedited runs of the
item's n words, so some run has at least (n - k) / (k + 1) words.  All runs of so many
words of an item (at most SEED) are looked up at every word of a document, and no
occurrence within the limit is missed, whatever its edits and the item's length.

Each candidate is verified by the exact word edit distance between the whole item and
the best-fitting stretch of the document around it.

Items are taken in blocks of ``block`` rows, so the index that goes to the workers
has a fixed largest size for any benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_kept, gram_hashes, like, lower_words, small_batches, steps, text_column

STRIDE, WALKS, SAMPLES, DRAWN = 4, 3, 6, 5
#: Words that a size class's walk covers at least; its walk has twice as many steps.
CLASSES = (4, 8, 16, 32)
SIEVE_BITS = 22
#: Words that an exact seed has at most.
SEED = 8
_rng = np.random.default_rng(424242)
_step_salt = _rng.integers(0, 2**63, (WALKS, 2 * CLASSES[-1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each class, walk and sample the steps that its key takes.
_drawn = {c: np.sort(np.argsort(_rng.random((WALKS, SAMPLES, 2 * c)), 2)[:, :, :DRAWN], 2) for c in CLASSES}


def walk(words: np.ndarray, starts: np.ndarray, w: int, n_steps: int):
    """The words copied at each step by walk w, from each start (words past the end read as 0)."""
    at, last = starts.astype(np.int64), len(words) - 1
    for j in range(n_steps):
        seen = words[np.minimum(at, last)]
        yield seen
        at = at + (((seen * _step_salt[w, j]) >> np.uint64(47)) & np.uint64(1)).astype(np.int64)


def keys(words: np.ndarray, starts: np.ndarray, classes=CLASSES):
    """(class, walk * SAMPLES + sample, keys of all starts) for every class."""
    if not classes:
        return
    for w in range(WALKS):
        open_ = {(c, s): np.full(len(starts), c * 1000 + w * SAMPLES + s + 1, np.uint64) for c in classes for s in range(SAMPLES)}
        use: dict[int, list[tuple[int, int]]] = {}
        for c, s in open_:
            for j in _drawn[c][w, s]:
                use.setdefault(int(j), []).append((c, s))
        for j, seen in enumerate(walk(words, starts, w, max(use) + 1)):
            for k in use.get(j, ()):
                open_[k] = (open_[k] ^ seen) * np.uint64(0x9E3779B97F4A7C15)
                open_[k] ^= open_[k] >> np.uint64(31)
        for (c, s), h in open_.items():
            yield c, w * SAMPLES + s, h


def size_class(n: int) -> int:
    """The largest class whose windows fit an item of n words from any of its first words on."""
    return max([c for c in CLASSES if c <= n - STRIDE + 1], default=CLASSES[0])


def seed_size(n: int, most: int) -> int:
    """Words of the exact run that any occurrence of an item of n words with at most so many edits holds (SEED at most)."""
    return min(SEED, max(1, -(-(n - most) // (most + 1))))


class Keys:
    """Keys, sorted, behind a bit sieve; each has an owner."""

    def __init__(self, found: list[np.ndarray], owner: list[np.ndarray]):
        self.keys = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner = self.keys[order], self.owner[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.keys >> np.uint64(64 - SIEVE_BITS)] = True

    def owners(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h whose key is known, and an owner for each (once for every owner)."""
        hit = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE_BITS)])
        lo, hi = (np.searchsorted(self.keys, h[hit], side) for side in ("left", "right"))
        many = hi - lo
        return np.repeat(hit, many), self.owner[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]


class ItemIndex:
    """Keys and exact seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_edit_percent: int = 20):
        col = pa.array([t or "" for _, t in items], pa.string())
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        for _, _, raw, off in steps(col):
            words, rows = lower_words(raw, off)
            self.words += [words[rows[k] : rows[k + 1]] for k in range(len(off) - 1)]
        found, owner = [], []
        self.classes = sorted({size_class(len(w)) for w in self.words if len(w)})
        for n, w in enumerate(self.words):
            if len(w):
                starts = np.arange(min(STRIDE, len(w)))
                for _, _, h in keys(np.append(w, np.uint64(0)), starts, (size_class(len(w)),)):
                    found.append(h)
                    owner.append(starts * len(self.words) + n)
        self.walks = Keys(found, owner)
        self.most = [len(w) * max_edit_percent // 100 for w in self.words]
        seeds: dict[int, tuple[list, list]] = {}
        for n, w in enumerate(self.words):
            if len(w):
                size = seed_size(len(w), self.most[n])
                found, owner = seeds.setdefault(size, ([], []))
                found.append(gram_hashes(w, size))
                owner.append(np.arange(len(found[-1])) * len(self.words) + n)
        self.seeds = {size: Keys(*x) for size, x in seeds.items()}

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct rows (place in the words, item, offset in the item)."""
        out, n = [], max(1, len(self.words))
        for _, _, h in keys(words, starts, self.classes):
            hit, own = self.walks.owners(h)
            out.append(np.stack([starts[hit], own % n, own // n], 1))
        for size, known in self.seeds.items():
            hit, own = known.owners(gram_hashes(words, size))
            out.append(np.stack([hit, own % n, own // n], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)


def best_fit(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance in words between the item and any stretch of the text, and where that ends."""
    row = np.zeros(len(text) + 1, np.int32)
    place = np.arange(len(text) + 1)
    for k, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def nearest(ix: ItemIndex, words: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], int]:
    """(row, item) -> edits of the item's best occurrence in the row, if near enough."""
    best: dict[tuple[int, int], int] = {}
    if not len(words):
        return best
    counts = np.diff(rows)
    per = -(-counts // STRIDE)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    starts = np.repeat(rows[:-1], per) + nth * STRIDE
    done: set[tuple[int, int, int]] = set()
    cand = ix.candidates(words, starts)
    doc = np.searchsorted(rows, cand[:, 0], "right") - 1
    for (s, item, o), d in zip(cand.tolist(), doc.tolist(), strict=True):
        w, most = ix.words[item], ix.most[item]
        if best.get((d, item), 1 << 30) == 0 or (d, item, s - o) in done:
            continue
        done.add((d, item, s - o))
        a, b = max(int(rows[d]), s - o - most), min(int(rows[d + 1]), s - o + len(w) + 2 * most)
        if b - a < len(w) - most or np.isin(words[a:b], w).sum() < len(w) - most:
            continue
        edits, _ = best_fit(w, words[a:b])
        if edits <= most:
            best[d, item] = min(edits, best.get((d, item), 1 << 30))
    return best


def occurrences(docs: DataFrame, items: list[tuple[int, str]], max_edit_percent: int, key: str) -> DataFrame:
    """key, item_id, edits: the best occurrence of each item of one block in each document, if near enough."""
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, max_edit_percent))
    kind = docs.schema[key].dataType

    def run(batches):
        drop_kept()
        ix: ItemIndex = index.value
        for batch in batches:
            for i, j, raw, off in steps(text_column(batch)):
                rows_out, items_out, edits_out = [], [], []
                for (d, item), edits in sorted(nearest(ix, *lower_words(raw, off)).items()):
                    rows_out.append(d)
                    items_out.append(ix.ids[item])
                    edits_out.append(edits)
                ids = like(batch.slice(i, j - i), key).take(pa.array(rows_out, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(items_out, pa.int64()), pa.array(edits_out, pa.int64())], [key, "item_id", "edits"])

    return docs.select(key, "text").mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType())]))


def item_blocks(benchmark: DataFrame, block: int):
    """The benchmark's items (item_id, text) in lists of at most about ``block``; those without id or text are left out."""
    kept = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = kept.count()
    blocks = 1 if n <= block else -(-n * 5 // (block * 4))
    placed = kept.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield [tuple(r) for r in placed.filter(F.col("_b") == b).orderBy("item_id", "text").select("item_id", "text").collect()]


def clean(docs: DataFrame, benchmark: DataFrame, max_edit_percent: int = 20, block: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item, by the rules of ``contaminated``; ids play no part.

    Rows are judged one by one: repeated rows and rows without id or text stay or go by their own text.
    """
    small_batches(docs.sparkSession)
    for items in item_blocks(benchmark, block):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, max_edit_percent))

        def run(batches, index=index):
            drop_kept()
            ix: ItemIndex = index.value
            for batch in batches:
                for i, j, raw, off in steps(text_column(batch)):
                    keep = np.ones(j - i, bool)
                    keep[[d for d, _ in nearest(ix, *lower_words(raw, off))]] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit_percent: int = 20, block: int = 20_000, key: str = "doc_id") -> DataFrame:
    """key, item_id, edits (exact edit distance in words) for each document row that holds a benchmark item.

    An item occurs where a stretch of the document is within ``max_edit_percent`` per
    cent (under 100) of the item's words of it; the search misses none.  Null, empty and wordless texts and items
    match nothing; items with a null id are left out; repeated rows give repeated
    results (repeated items: one row each).  Empty tables give an empty result.
    """
    small_batches(docs.sparkSession)
    out = None
    for items in item_blocks(benchmark, block):
        part = occurrences(docs, items, max_edit_percent, key)
        out = part if out is None else out.union(part)
    return out
