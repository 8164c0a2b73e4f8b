"""Shared helpers: steps in the shared folder, table reads, text slices and word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..session import discard, settle, shared_dir, ship

__all__ = ["discard", "new_path", "settle", "settle_and_watch", "shared_dir", "ship", "table"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle_and_watch(df: DataFrame, name: str, **watch: Column) -> tuple[DataFrame, dict]:
    """``settle``, and aggregates of the rows written, from the same job. Only the writing tasks that succeed count."""
    seen = Observation()
    back = settle(df.observe(seen, *[x.alias(k) for k, x in watch.items()]), name)
    return back, seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each (one longer text makes a slice of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and len+1 offsets; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hashes(data: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs that begin at ``starts``; bytes where ``counted`` is false do not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= up[: len(data)]
    value *= counted
    return mixed(np.add.reduceat(value, starts) * down[starts])


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word (run without the six ASCII white-space bytes) and the mask of word bytes."""
    word = ~SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~word[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(word & first), word


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each A-Z-lower-cased word of the texts, and len+1 word offsets of the texts."""
    starts, word = word_starts(data, offsets)
    return segment_hashes(LOWER[data], starts, word), np.searchsorted(starts, offsets)
