"""Harmonic packing of token pieces into sequences.

Class k (1 to ``classes``) holds pieces longer than capacity/(k+1) and up to capacity/k (the last class: all shorter
ones), and each of its bins takes exactly k pieces, so a piece's bin follows from its rank in its class. Ranks are
counted by each worker on its own; one small table of counts by worker and class joins them up. A tail that would
leave more than ``slack`` ids of its share of a bin empty is cut at the next exact share. The last, unfilled bins,
one a class at most, are put together first-fit.

A null text counts as empty and holds the end id alone; null or repeated ids, ties and repeated rows are documents
like any other; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_slices
from .tokens import encoder

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, nth long"
_TYPES = (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.int64(),)


def tail_cuts(capacity: int, classes: int, slack: int) -> list[list[tuple[int, int]]]:
    """For each tail length the (length, class) of its pieces."""
    out: list[list[tuple[int, int]]] = [[]]
    for n in range(1, capacity + 1):
        k = min(classes, capacity // n)
        if k == classes or capacity // k - n <= slack:
            out.append([(n, k)])
        else:
            share = capacity // (k + 1)
            out.append([(share, k + 1), *out[n - share]])
    return out


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, classes: int, slack: int) -> DataFrame:
    """Encode every whole text once, in the tasks that read it, and cut its ids into pieces of known class and rank."""
    cuts = tail_cuts(capacity, classes, slack)

    def cut(batches):
        from pyspark import TaskContext

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.asarray([end_id], "<u4").tobytes(), [0] * (classes + 1)
        for batch in text_slices(batches):
            rows = []
            ids, cut = coder.encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), cut[:-1], cut[1:]):
                wide = memoryview(ids[a:b].astype("<u4").tobytes() + end)
                n, at = len(wide) // 4, 0
                for length, k in [(capacity, 1)] * (n // capacity) + cuts[n % capacity]:
                    rows.append((doc_id, at, length, zlib.crc32(wide[4 * at : 4 * (at + length)]), n, k, part, seen[k]))
                    seen[k] += 1
                    at += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECE)


def first_fit(fills: dict[int, int], capacity: int) -> dict[int, int]:
    """Puts the unfilled bins (class: ids) together, longest first; class: number of the joint bin."""
    bins, place = [], {}
    for k, fill in sorted(fills.items(), key=lambda x: (-x[1], x[0])):
        at = next((i for i, used in enumerate(bins) if used + fill <= capacity), len(bins))
        bins += [0] * (at == len(bins))
        bins[at] += fill
        place[k] = at
    return place


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, classes: int = 64, slack: int = 32) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = settle(cut_documents(docs, tokenizer, end_id, capacity, classes, slack), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a worker
    bases = settle(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "bases")
    totals = {r["class"]: r["n"] for r in bases.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row a class
    ranked = pieces.join(bases.select("class", "part", "base"), ["class", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    full = {k: n // k for k, n in totals.items()}
    rest = [k for k, n in sorted(totals.items()) if n % k]
    of_class = lambda x: F.coalesce(*[F.when(F.col("class") == k, F.lit(int(v)).cast("long")) for k, v in x.items()], F.lit(0).cast("long"))
    in_rest = F.col("rank") >= F.col("class") * of_class(full)
    fills = {r["class"]: r["fill"] for r in ranked.where(in_rest).groupBy("class").agg(F.sum("length").alias("fill")).collect()} if rest else {}
    joint, at, first = first_fit(fills, capacity), 0, {}
    for k in sorted(full):
        first[k], at = at, at + full[k]
    sequence = F.when(in_rest, F.lit(at) + of_class(joint)).otherwise(of_class(first) + F.expr("rank div class"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("sequence_id", sequence).withColumn("offset", F.coalesce(offset, F.lit(0).cast("long"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
