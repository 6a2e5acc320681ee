"""Language identification by a byte convolutional network in numpy.

Byte embeddings, filters of several widths, max pooling over a fixed-length window
and a softmax.  For scoring, the embedding and a filter of width w fold into w
tables of 256 rows (and pairs of bytes into tables of 65,536 rows), so a
convolution is a few table look-ups per byte.  A document is cut into overlapping
windows that cover its whole text; its scores are the windows' probabilities,
averaged by their bytes.

Training reads a bounded, stratified sample of labelled rows: at most
``per_language`` rows of each label and ``max_rows`` in all, a row a label at least, chosen
by a hash of the key, ``pieces`` pieces of each.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and
every text if nothing could be learned (no labelled rows); a null key is scored but
never learned from.  Repeated rows are scored alike; an empty table gives an empty
result; columns besides key, text and the label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, crc_mod, drop_kept, like, small_batches, text_column, utf8_bytes

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8


class ByteConvNet:
    """Embedding (256, EMBED), a filter bank per width, softmax layer; trained with Adam."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.rng = labels, rng
        self.w = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.w[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32)
            self.w[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.w["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.w["c"] = np.zeros(len(labels), np.float32)

    def _forward(self, x: np.ndarray):
        emb, pooled, places = self.w["e"][x], [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            patches = np.concatenate([emb[:, i : i + n] for i in range(w)], axis=2)
            conv = patches @ self.w[f"f{w}"]
            places.append(conv.argmax(1))
            pooled.append(np.tanh(np.take_along_axis(conv, places[-1][:, None], 1)[:, 0] + self.w[f"b{w}"]))
        return np.concatenate(pooled, 1), places

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 500, batch: int = 64, rate: float = 0.01) -> ByteConvNet:
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        p = weight / weight.sum()
        for t in range(1, rounds + 1):
            pick = self.rng.choice(len(x), batch, p=p)
            bx = x[pick]
            h, places = self._forward(bx)
            z = h @ self.w["o"] + self.w["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(batch), y[pick]] -= 1
            d /= batch
            g = {"o": h.T @ d, "c": d.sum(0), "e": np.zeros_like(self.w["e"])}
            dh = (d @ self.w["o"].T) * (1 - h * h)
            for k, w in enumerate(WIDTHS):
                dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
                at = places[k][:, :, None] + np.arange(w)  # only the place of the maximum has a gradient
                bytes_there = np.take_along_axis(bx[:, None, :], at, 2)
                patch = self.w["e"][bytes_there].reshape(batch, FILTERS, w * EMBED)
                g[f"f{w}"] = np.einsum("bf,bfp->pf", dk, patch)
                g[f"b{w}"] = dk.sum(0)
                np.add.at(g["e"], bytes_there.ravel(), (dk[:, :, None] * self.w[f"f{w}"].T[None]).reshape(-1, EMBED))
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def folded(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The trained network as look-up tables."""

    def __init__(self, net: ByteConvNet):
        t = {(w, i): net.w["e"] @ net.w[f"f{w}"][i * EMBED : (i + 1) * EMBED] for w in WIDTHS for i in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.labels, self.net = net.labels, {k: net.w[k] for k in ("o", "c", *(f"b{w}" for w in WIDTHS))}
        self.two = pair(t[2, 0], t[2, 1])
        self.three, self.third = pair(t[3, 0], t[3, 1]), t[3, 2]
        self.four, self.fours = pair(t[4, 0], t[4, 1]), pair(t[4, 2], t[4, 3])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: windows by column (WINDOW, n), bytes; softmax by window."""
        p = x[:-1].astype(np.int32) * 256 + x[1:]
        pooled = (
            self.two[p].max(0) + self.net["b2"],
            (self.three[p[:-1]] + self.third[x[2:]]).max(0) + self.net["b3"],
            (self.four[p[:-2]] + self.fours[p[2:]]).max(0) + self.net["b4"],
        )
        z = np.tanh(np.concatenate(pooled, 1)) @ self.net["o"] + self.net["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def documents(self, raw: np.ndarray, off: np.ndarray, at_once: int = 128) -> np.ndarray:
        """Mean probabilities of each row's windows, weighted by the bytes each window adds."""
        step = WINDOW - max(WIDTHS) + 1
        size = np.diff(off)
        count = np.maximum(1, -(-np.maximum(0, size - (WINDOW - step)) // step))
        row = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = off[row] + nth * step
        held = np.minimum(off[row + 1] - start, WINDOW)
        low = np.concatenate([LOWER[raw], np.zeros(WINDOW, np.uint8)])
        total = np.zeros((len(size), len(self.labels)))
        inside = np.arange(WINDOW)[:, None]
        for i in range(0, len(row), at_once):
            s, h = start[i : i + at_once], held[i : i + at_once]
            x = low[s[None, :] + inside]
            if h.min() < WINDOW:
                x[inside >= h[None, :]] = 0
            np.add.at(total, row[i : i + at_once], self.probabilities(x) * np.maximum(h, 1)[:, None])
        return total / total.sum(1, keepdims=True)


def pieces_of(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, s in enumerate(texts):
        b = LOWER[np.frombuffer(s.encode()[:WINDOW], np.uint8)]
        x[i, : len(b)] = b
    return x


def train(docs: DataFrame, allowed, key: str = "doc_id", label: str = "lang", per_language: int = 1200, max_rows: int = 240_000, pieces: int = 3) -> Scorer | None:
    """Fit on a bounded sample of rows with a label for which ``allowed`` (a column) is true; None if there are none.

    Every label is learnt: from ``per_language`` rows, or fewer where all labels together
    would pass ``max_rows``, one at least.
    """
    known = docs.filter(allowed & F.col(label).isNotNull() & F.col("text").isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(label).count().collect()  # a row a label, as the network has a column for each
    if not counts:
        return None
    per_language = max(1, min(per_language, max_rows // len(counts)))
    # a row takes part in the choice if its hash is under its label's threshold: about twice the rows that are wanted
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40))
    limits = [(r[0], int((1 << 40) * min(1.0, (2 * per_language + 200) / r[1]))) for r in counts]
    limit = docs.sparkSession.createDataFrame(limits, T.StructType([T.StructField("_label", docs.schema[label].dataType), T.StructField("_limit", T.LongType())]))
    piece = lambda i: F.substring("text", (F.greatest(F.lit(0), F.length("text") - WINDOW) * F.lit(i / max(1, pieces - 1))).cast("int") + 1, F.lit(WINDOW))
    picked = known.withColumn("_h", h).join(F.broadcast(limit), F.col(label) == F.col("_label")).filter("_h < _limit").select(label, "_h", F.col(key).alias("_k"), F.array(*(piece(i) for i in range(pieces))).alias("_p"))
    order = W.partitionBy(label).orderBy("_h", "_k", "_p")
    sample = picked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language).select(label, "_h", "_k", "_p").collect()
    sample.sort(key=lambda r: (r[0], r[1], str(r[2]), r[3]))
    labels = sorted({r[0] for r in sample})
    x = pieces_of([s for r in sample for s in dict.fromkeys(r[3])])
    y = np.array([labels.index(r[0]) for r in sample for _ in dict.fromkeys(r[3])])
    return ByteConvNet(labels).fit(x, y, 1 / np.bincount(y, minlength=len(labels))[y]).folded()


def identify(docs: DataFrame, scorer: Scorer | None, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the ``keep`` columns, lang_pred and score."""
    small_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c != key)
    fields = [docs.schema[c] for c in (key, *keep)]
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # tables of a fixed size

    def run(batches):
        drop_kept()
        net = shared.value
        for batch in batches:
            col = text_column(batch)
            letters = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
            if net is None or not len(col):
                name, score = ["und"] * len(col), np.zeros(len(col))
            else:
                p = net.documents(*utf8_bytes(col))
                name = [net.labels[k] if ok else "und" for k, ok in zip(p.argmax(1), letters, strict=True)]
                score = np.where(letters, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*(like(batch, f.name) for f in fields), pa.array(name, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

    return docs.select(key, *keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, key: str = "doc_id", folds: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, held_out (crc32 of the key as text is 0 modulo ``folds``), lang_pred, score, and the ``keep`` columns."""
    scorer = train(docs, crc_mod(key, folds) > 0, key)
    out = identify(docs, scorer, key, keep)
    return out.select(key, (crc_mod(key, folds) == 0).alias("held_out"), "lang_pred", "score", *(c for c in keep if c != key))
