"""Helpers shared by the text operators: shared storage, Arrow access, vectorised words.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; lower-casing touches
A-Z only.  Both are byte-level rules, so whole Arrow batches are handled as one
``uint8`` array, without a Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpointed, delete, shared_dir, shared_path  # noqa: F401

#: Bytes of text that one vectorised step handles (one longer document is a step of its own).
STEP_BYTES = 1 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return checkpointed(df, label)


def drop_path(spark: SparkSession, path: str) -> None:
    delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so that long documents don't add up in a worker.

    A session setting that stays: results are lazy, and it has to hold when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_kept: dict[str, object] = {}


def kept_in_worker(name: str, make: Callable[[], object]):
    """What this process keeps from task to task under ``name``; made, in place of what it kept under other names, if it isn't there."""
    if name not in _kept:
        drop_kept()
        _kept[name] = make()
    return _kept[name]


def drop_kept() -> None:
    """Give the memory of what this process keeps back to the system: a worker that one operator's tasks have left runs the next one's."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


def crc_mod(key: str, n: int):
    """crc32 of the key as text, modulo n (-1 for a null key)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % F.lit(n), F.lit(-1))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "")


def utf8_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def steps(col: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    raw, off = utf8_bytes(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 4 * STEP_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of a polynomial."""
    if not len(starts):
        return np.empty(0, np.uint64)
    terms = _BYTE[raw]
    terms *= _power(_BASE, len(raw))[: len(raw)]
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    h = total[ends] - total[starts]
    h *= _power(_BASE_INV, len(raw))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~SPACE[raw]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    before[off] = False
    starts = np.flatnonzero(inside[:n] & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside[:n] & ~after[:n]) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and for each row the index of its first word."""
    low = LOWER[raw]
    starts, ends, rows = word_spans(low, off)
    return span_hashes(low, starts, ends), rows


_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (the last k-1 places are left out)."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * _GRAM[i % 64]
        h ^= h >> np.uint64(29)
    return mix(h)


def row_ids(bounds: np.ndarray) -> np.ndarray:
    """bounds of rows in an array -> the row of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def like(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
