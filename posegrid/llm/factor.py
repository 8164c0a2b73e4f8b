"""Quality by a factorisation machine on hashed words, structure statistics and text metadata.

A text's features are its words hashed into ``BUCKETS`` (share of its words), statistics of its structure and its
length class. The score is the logistic of bias, linear terms and all pairwise interactions of rank RANK, the latter
in linear time: half the difference of the squared sum and the sum of squares in each factor. Learning is by AdaGrad
on a bounded sample of labelled rows (about ``sample`` by the smallest hash of the id) that are not held out.

A null text counts as empty; empty texts have their statistics alone and are scored like others. Labels without a
value are not learned from; of several for a document the lowest counts. If nothing can be learned, all scores are
those of the untrained model. Repeated rows and null or repeated ids are scored row by row. Extra columns are not
read. An empty table gives no rows. Of a repeated id's rows the one of the least text is learned from, so the driver gets
``sample`` vectors at most, of 128 KB at most each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes, text_slices, word_hashes, word_starts
from .crossparse import held_out

BUCKETS, RANK, SAMPLE, EPOCHS, BATCH, RATE, DECAY = 1 << 14, 8, 6_000, 12, 128, 0.1, 1e-6
LENGTHS = 12  # length classes: powers of two of the number of words
STATISTICS = ("symbols", "marks", "capitals", "digits", "breaks", "long bytes", "word length", "repeated words", "same as before", "short lines", "shares")
WIDTH = BUCKETS + len(STATISTICS) + LENGTHS
_KINDS = {"symbols": b"#*$%&|<>{}[]=_\\^~", "marks": b"!?.,;:", "digits": b"0123456789", "breaks": b"\n"}


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, value) of whole texts, sorted by row, each pair once."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    hashes, at = word_hashes(data, offsets)
    words, size = np.diff(at), np.diff(offsets)
    row = np.repeat(np.arange(n), words)
    key = (row << 14) | (hashes >> np.uint64(50)).astype(np.int64)
    pair, count = np.unique(key, return_counts=True)
    r, c = pair >> 14, pair & (BUCKETS - 1)
    value = count / words[r]

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    masks = {k: np.isin(data, np.frombuffer(v, np.uint8)) for k, v in _KINDS.items()} | {"capitals": (data >= 65) & (data <= 90), "long bytes": data >= 128}
    stats = {k: share(m) for k, m in masks.items()}
    distinct = np.bincount(r, minlength=n) / np.maximum(words, 1)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    stats["word length"] = share(word_starts(data, offsets)[1]) * size / np.maximum(words, 1) / 10
    stats["repeated words"] = 1 - distinct
    stats["same as before"] = np.bincount(row, same, minlength=n) / np.maximum(words, 1)
    stats["short lines"] = np.minimum(1, stats["breaks"] * 20)
    stats["shares"] = np.bincount(r, value**2, minlength=n)
    scale = {"symbols": 10, "marks": 5, "capitals": 4, "digits": 5, "breaks": 20, "same as before": 2}
    rows, columns, values = [r], [c], [value]
    for i, k in enumerate(STATISTICS):
        rows.append(np.arange(n))
        columns.append(np.full(n, BUCKETS + i))
        values.append(np.minimum(stats[k] * scale.get(k, 1), 4.0))
    rows.append(np.arange(n))
    columns.append(BUCKETS + len(STATISTICS) + np.minimum(np.log2(words + 1).astype(np.int64), LENGTHS - 1))
    values.append(np.ones(n))
    rows, columns, values = (np.concatenate(x) for x in (rows, columns, values))
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order].astype(np.int32), values[order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # RANK x WIDTH

    def logits(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.linear[column] * value, minlength=n)
        for v in self.factors:
            x = v[column] * value
            out += 0.5 * (np.bincount(row, x, minlength=n) ** 2 - np.bincount(row, x * x, minlength=n))
        return out


def untrained() -> Machine:
    return Machine(0.0, np.zeros(WIDTH, np.float32), (np.random.default_rng(11).standard_normal((RANK, WIDTH)) * 0.05).astype(np.float32))


def train(examples: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Machine:
    """AdaGrad on the log loss; each class weighs the same in all."""
    m = untrained()
    if not examples:
        return m
    y = np.asarray([e[0] for e in examples])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    seen, seen_v, seen_b, rng = np.full(WIDTH, 1e-6), np.full((RANK, WIDTH), 1e-6), 1e-6, np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            who = order[at : at + BATCH]
            column = np.concatenate([examples[i][1] for i in who])
            value = np.concatenate([examples[i][2] for i in who]).astype(np.float64)
            row = np.repeat(np.arange(len(who)), [len(examples[i][1]) for i in who])
            slope = (1 / (1 + np.exp(-np.clip(m.logits(row, column, value, len(who)), -30, 30))) - y[who]) * weight[who] / len(who)
            seen_b += slope.sum() ** 2
            m.bias -= RATE * slope.sum() / np.sqrt(seen_b)
            g = np.bincount(column, slope[row] * value, minlength=WIDTH) + DECAY * m.linear
            seen += g * g
            m.linear -= (RATE * g / np.sqrt(seen)).astype(np.float32)
            for f in range(RANK):
                v = m.factors[f]
                x = v[column] * value
                total = np.bincount(row, x, minlength=len(who))
                g = np.bincount(column, slope[row] * value * (total[row] - x), minlength=WIDTH) + DECAY * v
                seen_v[f] += g * g
                v -= (0.5 * RATE * g / np.sqrt(seen_v[f])).astype(np.float32)
    return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Features are made on the executors; the driver gets those of about ``sample`` documents."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, sample / max(1, rows.count()))
    picked = rows.where(unit < share)  # about ``sample`` rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def run(batches):
        for part in text_slices(batches):
            row, column, value = features(part.column(1))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *(pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for x in (column, value))], names=["doc_id", "y", "column", "value"])

    found = texts.mapInArrow(run, "doc_id long, y int, column binary, value binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["column"], r["value"]))
    return train([(float(r["y"]), np.frombuffer(r["column"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found])


def probability(spark: SparkSession, machine: Machine) -> Callable[[Column], Column]:
    """The chance that a text (a column) is good; only the texts go to Python, and only numbers come back."""
    own = spark.sparkContext.broadcast(machine)  # WIDTH * (RANK + 1) floats, whatever the input

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], 0):
            row, column, value = features(part.column(0))
            out.append(1 / (1 + np.exp(-np.clip(own.value.logits(row, column, value, part.num_rows), -30, 30))))
        return pa.array(np.concatenate(out))

    return run


def score(docs: DataFrame, machine: Machine, least: float = 0.7, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; columns named in ``keep`` stay beside them."""
    p = probability(docs.sparkSession, machine)(F.col(text_col).cast("string"))
    own = [F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), p.alias("score"), *own)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), *[F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)])
