"""Invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (sentences where a line has several, pieces of 20 words where those run long) become digests of
their bytes and of how often the same paragraph came before. A sketch adds each digest to three cells: count, xor of
digests, xor of checks. Two sketches subtract cell by cell; peeling cells that hold one digest recovers the digests
on either side only. If peeling stalls, both texts are sketched again with four times the cells. Likeness is the
share of common digests in all digests. The printed fingerprint is the sketch of the first size, with its count.

A null text counts as empty, which has no paragraphs: two empty texts have likeness 1. Of rows that share an id the
later text comes first in the ring; equal rows are each other's neighbours. Rows without an id come last.
Extra columns are not read. An empty table gives no rows; the next document of a lone one is itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, mixed, segment_hashes, text_slices, text_bytes, word_starts
from .deal import parts_of, range_bounds, range_of

CELLS, HASHES, GROWTH, LONG_WORDS = 24, 3, 4, 20
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_SALT = mixed(np.arange(100, 100 + HASHES + 2, dtype=np.uint64))


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of the texts, distinct within each, and the row of each digest."""
    data, offsets = text_bytes(texts)
    starts, _ = word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    # A word begins a paragraph at a text's start, after a line break, and after a sentence's end and a space.
    breaks = np.cumsum(np.concatenate([[0], data == 10]))
    gap = np.zeros(len(starts), bool)
    gap[1:] = breaks[starts[1:]] != breaks[starts[:-1]]
    before = np.maximum(starts - 2, 0)
    gap |= (starts >= 2) & _ENDS[data[before]] & SPACE[data[np.maximum(starts - 1, 0)]]
    gap[0] = True
    gap[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(gap)
    within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    gap |= within % LONG_WORDS == 0
    row = row[gap]
    counted = np.ones(len(data), bool)
    spaces = SPACE[data]
    counted[spaces & np.append(spaces[1:], True)] = False  # white space at a paragraph's end, or doubled, is no part of it
    ends = np.flatnonzero(spaces & ~np.append(spaces[1:], False))
    nxt = np.searchsorted(starts[gap], ends + 1)
    counted[ends[(nxt < gap.sum()) & (starts[gap][np.minimum(nxt, gap.sum() - 1)] == ends + 1)]] = False
    value = segment_hashes(data, starts[gap], counted)
    # How often the same digest came before in its text makes repeats distinct.
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    nth = np.arange(len(v)) - np.repeat(at, np.diff(np.append(at, len(v))))
    return mixed(v + nth.astype(np.uint64) * _SALT[-1]), r


def _cells(digest: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
    """A cell of each third of a sketch with ``size`` cells."""
    third = np.asarray(size, np.uint64) // np.uint64(HASHES)
    return [(mixed(digest ^ _SALT[i]) % third + np.uint64(i) * third).astype(np.int64) for i in range(HASHES)]


def sketch(digest: np.ndarray, row: np.ndarray, rows: int, size: int, sign: int = 1, into=None):
    """Arrays (count, digest xor, check xor) of rows*size cells."""
    count, xor, check = into if into else (np.zeros(rows * size, np.int64), np.zeros(rows * size, np.uint64), np.zeros(rows * size, np.uint64))
    proof = mixed(digest ^ _SALT[HASHES])
    for cell in _cells(digest, size):
        at = row * size + cell
        count += sign * np.bincount(at, minlength=len(count))
        np.bitwise_xor.at(xor, at, digest)
        np.bitwise_xor.at(check, at, proof)
    return count, xor, check


def peel(cells, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many digests only the left and only the right side has, and whether a row peeled fully."""
    count, xor, check = cells
    left, right = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    while True:
        pure = np.flatnonzero(np.abs(count) == 1)
        pure = pure[mixed(xor[pure] ^ _SALT[HASHES]) == check[pure]]
        if not len(pure):
            break
        row, digest, sign = pure // size, xor[pure], count[pure]
        order = np.lexsort((digest, row))
        row, digest, sign = row[order], digest[order], sign[order]
        one = np.ones(len(row), bool)
        one[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
        row, digest, sign = row[one], digest[one], sign[one]
        left += np.bincount(row[sign > 0], minlength=rows)
        right += np.bincount(row[sign < 0], minlength=rows)
        proof = mixed(digest ^ _SALT[HASHES])
        for cell in _cells(digest, size):
            at = row * size + cell
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(xor, at, digest)
            np.bitwise_xor.at(check, at, proof)
    full = ~np.any((count != 0).reshape(rows, size) | (xor != 0).reshape(rows, size), axis=1)
    return left, right, full


def likeness(a: tuple, b: tuple, rows: int, size: int = CELLS) -> np.ndarray:
    """Share of common digests in all, by subtraction and peeling, larger for the rows that stall."""
    out, todo = np.ones(rows), np.arange(rows)
    n_a, n_b = np.bincount(a[1], minlength=rows), np.bincount(b[1], minlength=rows)
    while len(todo):
        index = np.full(rows, -1)
        index[todo] = np.arange(len(todo))
        parts = [(d[index[r] >= 0], index[r][index[r] >= 0]) for d, r in (a, b)]
        # Rows are few where sketches are large: cells are held for a bounded number of rows at once.
        step, stalled = max(1, (1 << 20) // size), []
        for at in range(0, len(todo), step):
            n = min(step, len(todo) - at)
            (da, ra), (db, rb) = [(d[(r >= at) & (r < at + n)], r[(r >= at) & (r < at + n)] - at) for d, r in parts]
            left, right, full = peel(sketch(db, rb, n, size, -1, sketch(da, ra, n, size)), n, size)
            who = todo[at : at + n]
            common, whole = n_a[who] - left, n_a[who] + right
            out[who] = np.where(whole > 0, common / np.maximum(whole, 1), 1.0)
            stalled.append(who[~full])
        todo, size = np.concatenate(stalled), size * GROWTH
    return out


def printed(a: tuple, rows: int, size: int = CELLS) -> list[str]:
    """Fingerprints: the number of digests, then count (16 bits), digest and check (32 bits) of each cell, in hex."""
    count, xor, check = sketch(*a, rows, size)
    cells = np.zeros(rows * size, np.dtype([("n", ">u2"), ("x", ">u8"), ("c", ">u4")]))
    cells["n"], cells["x"], cells["c"] = count & 0xFFFF, xor, check >> np.uint64(32)
    n = np.bincount(a[1], minlength=rows)
    data, width = cells.tobytes(), size * cells.itemsize
    return [f"{k:08x}" + data[i * width : (i + 1) * width].hex() for i, k in enumerate(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ranges of the id are dealt to partitions and sorted; each partition also gets the first document of the next
    lower range (the lowest gets the highest document), so every document meets its next one with one shuffle of
    the texts and a copy of one document a partition.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", parts_of(docs))
    ids = rows.select("doc_id", (F.lit(len(bounds)) - range_of(F.col("doc_id"), bounds)).alias("range"))
    tops = {r["range"]: (r["top"], r["n"]) for r in ids.groupBy("range").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()}  # a row a range
    used = sorted(tops)
    # The head of each range ends the range before it; the first head ends the last range.
    heads = {tops[r][0]: used[i - 1] for i, r in enumerate(used)}
    place = F.lit(len(bounds)) - range_of(F.col("doc_id"), bounds)
    copies = _looked_up(F.col("doc_id"), heads)
    dealt = rows.select("doc_id", "text", place.alias("range"), copies.alias("copy"))
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.col("copy").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("tail")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("tail")), F.struct(F.col("copy").alias("range"), F.lit(1).alias("tail"))))).alias("at")).select("doc_id", "text", "at.*")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(F.asc("tail"), F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches):
        held: tuple | None = None  # the last row waits for its next one
        done = False
        for part in text_slices(batches):
            ids, texts, tails = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
            keep = len(ids)
            if 1 in tails:
                keep = tails.index(1) + 1
            if done:
                continue
            done = keep < len(ids) or (keep and tails[keep - 1] == 1)
            ids, texts = ids[:keep], texts[:keep]
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                yield _compared(ids[:-1], texts, cells)

    return dealt.select("doc_id", "text", "tail").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _RESULT))


_RESULT = (("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], cells: int) -> pa.RecordBatch:
    """``texts`` has one text more than ``ids``: the next one's of the last."""
    n = len(ids)
    other = [edited(texts[i], texts[i + 1]) for i in range(n)]
    every, own_row = digests(pa.array(texts, pa.string()))
    changed = digests(pa.array(other, pa.string()))
    own = (every[own_row < n], own_row[own_row < n])
    following = (every[own_row > 0], own_row[own_row > 0] - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other]),
         pa.array(printed(own, n, cells), pa.string()), pa.array(printed(changed, n, cells), pa.string()), pa.array(likeness(own, changed, n, cells)), pa.array(likeness(own, following, n, cells))],
        names=[x for x, _ in _RESULT])


def _looked_up(key, places: dict[int | None, int]):
    """The place of a key, of which there is at most one a range; null for others."""
    least = -(1 << 63)
    known = pd.Series({least if k is None else k: v for k, v in places.items()}, dtype="Int32")

    @F.pandas_udf("int")
    def find(x: pd.Series) -> pd.Series:
        return x.map(known).astype("Int32")

    return find(F.coalesce(key, F.lit(least).cast("long")))
