"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy arrays.

Statistics come from vectorised passes over whole batches of text.  Trees are grown
on binned features with logistic loss; a feature with a constraint gets only splits
that keep the score monotonic in it, and the leaves below stay on their side of the
middle between both halves.

Training reads at most ``sample`` labelled documents, chosen by a hash of the key.

Defined results: null and wordless texts have zero statistics and are not kept;
without labels the verdict is the base rules' alone; a document with several label
rows takes part once, with the smallest label; repeated rows are judged alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, gram_hashes, like, mix, row_ids, small_batches, span_hashes, steps, text_column, word_spans

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature -> monotonic constraint of the score (-1: no better with more, 1: no worse, 0: none).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "punct_share": 0, "letter_share": 0, "bars_per_word": -1, "words_per_line": 0, "distinct_share": 1, "short_line_share": 0}

_CLASS = {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": b"0123456789", "punct": b".,;:!?'\"()-", "bar": b"|"}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}
_TABLES["letter"] = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_TABLES["point"] = (np.arange(256) & 0xC0) != 0x80


def _count(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[off[1:]] - total[off[:-1]]).astype(np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(keys) else False
    return out


def statistics(raw: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of each row."""
    n = len(off) - 1
    starts, ends, rows = word_spans(raw, off)
    words, per = span_hashes(raw, starts, ends), np.diff(rows)
    counts = {k: _count(t[raw], off) for k, t in _TABLES.items()}
    inside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    chars = _count(_TABLES["point"][raw] & inside, off)
    # words in 3-word windows that occur twice or more in the same text
    doc = row_ids(rows)
    grams = gram_hashes(words, 3)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    whole = doc[: len(grams)] == doc[2:] if len(words) >= 3 else np.zeros(0, bool)
    place = np.flatnonzero(whole)
    again = place[repeated(mix(grams[place]) ^ salt[doc[place]])]
    marked = np.zeros(len(words), bool)
    for i in range(3):
        marked[again + i] = True
    repeat = np.bincount(doc[marked], minlength=n)
    # lines: pieces between \n, within a row
    cut = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    stop = np.sort(np.concatenate([cut, off[1:]]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(off, cut, "right") - 1]), kind="stable")
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_doc = begin[has_word], stop[has_word], line_doc[has_word]
    keys = span_hashes(raw, begin, stop) ^ salt[line_doc]
    first = np.unique(keys, return_index=True)[1] if len(keys) else np.empty(0, np.int64)
    lines = np.bincount(line_doc, minlength=n)
    dup = lines - np.bincount(line_doc[first], minlength=n)
    short = np.bincount(line_doc[(np.searchsorted(starts, stop) - np.searchsorted(starts, begin)) <= 3], minlength=n)
    lowered = span_hashes(LOWER[raw], starts, ends) ^ salt[doc]
    kinds = np.bincount(doc[np.unique(lowered, return_index=True)[1]], minlength=n) if len(words) else np.zeros(n, np.int64)
    base = dict(zip(BASE, (per.astype(np.int64), chars, counts["symbol"], dup.astype(np.int64), repeat.astype(np.int64)), strict=True))
    w, c, ln = np.maximum(per, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    x = np.stack([np.log1p(per), chars / w, counts["symbol"] / w, dup / ln, repeat / w, counts["upper"] / c, counts["digit"] / c, counts["punct"] / c, counts["letter"] / np.maximum(np.diff(off), 1), counts["bar"] / w, per / ln, kinds / w, short / ln], 1)
    return base, x.astype(np.float64)


@dataclass
class Forest:
    """All trees in one array per node field; children of a leaf are the leaf itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 5.0, least: int = 10) -> Forest:
    """Boosted trees with logistic loss for y in {0, 1}."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    z = np.full(len(y), bias)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            best, gs, hs = None, g[rows].sum(), h[rows].sum()
            if level < depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    wl, wr = np.clip(-gl / (hl + penalty), low, high), np.clip(-(gs - gl) / (hs - hl + penalty), low, high)
                    gain = -(gl * wl + 0.5 * (hl + penalty) * wl**2) - ((gs - gl) * wr + 0.5 * (hs - hl + penalty) * wr**2)
                    ok = (nl >= least) & (len(rows) - nl >= least) & ((wr - wl) * monotone[f] >= 0)
                    if ok.any():
                        k = int(np.where(ok, gain, -np.inf).argmax())
                        if best is None or gain[k] > best[0]:
                            best = (gain[k], f, k, wl[k], wr[k])
            w = float(np.clip(-gs / (hs + penalty), low, high))
            if best is None or best[0] <= -(gs * w + 0.5 * (hs + penalty) * w * w) + 1e-6:
                nodes[at][4] = rate * w
                z[rows] += rate * w
                continue
            _, f, k, wl, wr = best
            goes = binned[rows, f] <= k
            mid = (wl + wr) / 2
            left, right = len(nodes), len(nodes) + 1
            nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, right, right, 0.0]]
            nodes[at] = [f, float(edges[f][k]), left, right, 0.0]
            m = monotone[f]
            todo.append((left, rows[goes], level + 1, mid if m < 0 else low, mid if m > 0 else high))
            todo.append((right, rows[~goes], level + 1, mid if m > 0 else low, mid if m < 0 else high))
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth, bias)


def _arrow(docs: DataFrame, key: str, made, schema: T.StructType, extra: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, raw, off in steps(text_column(batch)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(like(part, c) for c in extra), *made(*statistics(raw, off))], schema.names)

    return docs.select(*extra, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = 20_000) -> Forest | None:
    """Fit on at most about ``sample`` labelled documents; None without both labels."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("double").alias("_y"))
    n = known.count()
    share = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(n, 1)))
    rows = docs.select(key, "text").join(F.broadcast(known.filter(share)), key)  # about ``sample`` keys
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("_y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    small_batches(docs.sparkSession)
    got = _arrow(rows, key, lambda base, x: [pa.array(list(x), pa.list_(pa.float64()))], schema, [key, "_y"]).collect()
    if not got or len({r[1] > 0 for r in got}) < 2:
        return None
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return grow(np.array([r[2] for r in got]), np.array([float(r[1] > 0) for r in got]), list(FEATURES.values()))


def judged(docs: DataFrame, forest: Forest | None, key: str = "doc_id", threshold: float = 0.0) -> DataFrame:
    """key, the base counts, base_failed, kept, and the trees' score (log-odds; null without trees)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # a few thousand nodes

    def made(base, x):
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        score = shared.value.score(x) if shared.value is not None else np.full(len(x), np.nan)
        kept = ~failed & ~(score < threshold)
        return [*(pa.array(base[k]) for k in BASE), pa.array(failed), pa.array(kept), pa.array(score, mask=np.isnan(score))]

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("tree_score", T.DoubleType())])
    return _arrow(docs, key, made, schema, [key])


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base rules and trees trained on the labels, over every whole text."""
    return judged(docs, train(docs, labels, key), key)
