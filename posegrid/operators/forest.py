"""Random decision forests over depth images: features, histograms, splits, growth and inference."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.adapters import FAR, SIDE


def uv_candidates(n: int, reach: float, power: float = 1.0, seed: int = 0) -> np.ndarray:
    """(n, 4) offsets, uniform in [-reach/2, reach/2] and then signed powers."""
    u = np.random.Generator(np.random.MT19937(seed)).uniform(-reach / 2, reach / 2, (n, 4))
    return np.sign(u) * np.abs(u) ** power


def threshold_ladder(n: int, reach: float) -> list[float]:
    """0, +s, -s, +2s, ... with s = reach / ((n - 1) / 2); n is made odd, so no rung is missing."""
    n += 1 - n % 2
    step = reach / max(1, (n - 1) // 2)
    return [((k + 1) // 2) * step * (1 if k % 2 else -1) for k in range(n)]


def read_depth(depth: Column, x: Column, y: Column, side: int = SIDE, far: float = FAR) -> Column:
    """Depth at a pixel; outside the image it is ``far``."""
    inside = (x >= 0) & (x < side) & (y >= 0) & (y < side)
    return F.when(inside, F.get(depth, F.when(inside, y * side + x).otherwise(0))).otherwise(F.lit(far))


def uv_gradient(depth: Column, x: Column, y: Column, uv: tuple[float, float, float, float], mirror: bool = False) -> Column:
    """Depth difference at two offsets that shrink with distance; casts truncate; mirrored ones negate x offsets."""
    d = F.get(depth, y * SIDE + x)
    sign = -1.0 if mirror else 1.0
    at = lambda a, b: read_depth(depth, (x + F.lit(sign * a) / d).cast("int"), (y + F.lit(b) / d).cast("int"))
    return at(uv[0], uv[1]) - at(uv[2], uv[3])


def mirrored(depth: Column, side: int = SIDE) -> Column:
    """An image with each row reversed."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get(depth, i - i % side + (side - 1) - i % side))


def uvt_histograms(samples: DataFrame, uv: list[tuple[int, int]], thresholds: list[float], vector: str = "embedding") -> DataFrame:
    """Label counts left of and right of each threshold of each candidate: node, c, t, label, n_left, n_right.

    ``samples`` has node, label and a vector; a candidate is a pair of its positions. Each task counts its own rows in
    numpy (candidates x thresholds x labels cells, whatever the rows), and one sum joins the tasks.
    """
    ship(samples.sparkSession)
    u, v, cuts = np.asarray([a for a, _ in uv]), np.asarray([b for _, b in uv]), np.asarray(thresholds)
    order = np.argsort(cuts, kind="stable")

    def count(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            e = flat.reshape(batch.num_rows, -1)
            slot = np.searchsorted(cuts[order], e[:, u] - e[:, v], side="right")  # cuts before slot are <= the value
            for key in sorted(set(zip(node.tolist(), label.tolist()))):
                rows = slot[(node == key[0]) & (label == key[1])]
                cells = np.zeros((len(u), len(cuts) + 1), np.int64)
                np.add.at(cells, (np.tile(np.arange(len(u)), len(rows)), rows.ravel()), 1)
                held[key] = held.get(key, 0) + cells
        if held:
            columns: list[list] = [[] for _ in range(6)]
            for (node, label), cells in held.items():
                right = cells[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # values at or over the cut
                total = cells.sum(axis=1, keepdims=True)
                c, k = np.meshgrid(np.arange(len(u)), order, indexing="ij")
                for x, y in zip(columns, (np.full(c.size, node), c.ravel(), k.ravel(), np.full(c.size, label), (total - right).ravel(), right.ravel())):
                    x.append(y)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(columns, kinds)], names=["node", "c", "t", "label", "n_left", "n_right"])

    parts = samples.select(F.col("node").cast("long"), F.col("label").cast("int"), vector).mapInArrow(count, "node long, c int, t int, label int, n_left long, n_right long")
    return parts.groupBy("node", "c", "t", "label").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def entropy(counts: Column, total: Column) -> Column:
    """Summand -p log2 p of a label's share; 0 where the share is 0 or 1."""
    p = counts / total
    return F.when((counts > 0) & (counts < total), -p * F.log2(p)).otherwise(F.lit(0.0))


def split_gains(histograms: DataFrame) -> DataFrame:
    """Information gain of each candidate split: node, c, t, n_left, n_right, gain."""
    whole = F.col("n_left") + F.col("n_right")
    w = ["node", "c", "t"]
    totals = histograms.groupBy(*w).agg(F.sum("n_left").alias("left"), F.sum("n_right").alias("right"))
    parts = histograms.join(totals, w).groupBy(*w).agg(
        F.max("left").alias("n_left"), F.max("right").alias("n_right"),
        F.sum(entropy(whole, F.col("left") + F.col("right"))).alias("h"), F.sum(entropy(F.col("n_left"), F.col("left"))).alias("h_left"), F.sum(entropy(F.col("n_right"), F.col("right"))).alias("h_right"))
    n = F.col("n_left") + F.col("n_right")
    return parts.select(*w, "n_left", "n_right", (F.col("h") - F.col("n_left") / n * F.col("h_left") - F.col("n_right") / n * F.col("h_right")).alias("gain"))


def best_splits(gains: DataFrame) -> DataFrame:
    """The split of most gain for each node; ties go to the lowest candidate, then the lowest rung."""
    rounded = F.round("gain", 9)
    return gains.groupBy("node").agg(F.max_by(F.struct("c", "t", "gain"), F.struct(rounded, -F.col("c"), -F.col("t"))).alias("b")).select("node", "b.*")


def route(samples: DataFrame, splits: DataFrame, uv: list[tuple[int, int]], thresholds: list[float], vector: str = "embedding") -> DataFrame:
    """Move samples of split nodes to their children (2n+1 left, 2n+2 right); the rest stay out."""
    at = lambda ks: F.array(*[F.lit(k) for k in ks])
    value = F.get(vector, F.get(at([a for a, _ in uv]), F.col("c"))).cast("double") - F.get(vector, F.get(at([b for _, b in uv]), F.col("c"))).cast("double")
    left = value < F.get(at([float(t) for t in thresholds]), F.col("t"))
    kept = [c for c in samples.columns if c != "node"]
    return samples.join(F.broadcast(splits.select("node", "c", "t")), "node").select(*kept, F.when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2).alias("node"))


def train_tree(samples: DataFrame, uv: list[tuple[int, int]], thresholds: list[float], depth: int, settle=lambda df: df) -> DataFrame:
    """Grow a tree a level at a time: one aggregation for all open nodes of a level.

    Returns node, c, t, gain, n, is_leaf, pr (label: share). A node is a leaf where no split gains, or at the last
    level. The frontier is at most 2^depth rows. ``settle`` may cut lineage between levels (checkpoint or table).
    """
    rows = samples.withColumn("node", F.lit(0).cast("long"))
    out = None
    for level in range(depth):
        counts = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
        pr = counts.groupBy("node").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), "n")))).alias("counts"))
        pr = pr.select("node", "n", F.transform_values("counts", lambda k, v: v / F.col("n")).alias("pr"))
        if level + 1 < depth:
            best = settle(best_splits(split_gains(uvt_histograms(rows, uv, thresholds))).where("round(gain, 9) > 0"))
            nodes = pr.join(best, "node", "left")
            rows = settle(route(rows, best, uv, thresholds))
        else:
            nodes = pr.select("*", F.lit(None).cast("int").alias("c"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("double").alias("gain"))
        nodes = nodes.select("node", "c", "t", "gain", "n", F.col("c").isNull().alias("is_leaf"), "pr")
        out = nodes if out is None else out.unionByName(nodes)
    return out


def walk(samples: DataFrame, nodes: DataFrame, uv: list[tuple[int, int]], thresholds: list[float], depth: int, vector: str = "embedding") -> DataFrame:
    """Leaf of each sample in each tree: the columns of ``samples`` but the vector, tree and node.

    ``nodes`` (tree, node, c, t; null: leaf) is a model of at most trees * 2^depth rows. Its splits are broadcast as
    arrays, and each batch of samples goes down all levels of all trees in numpy: one pass, no shuffle, no join.
    """
    spark = samples.sparkSession
    ship(spark)
    model: dict[int, list[tuple]] = {}
    for tree, node, c, t in nodes.select("tree", "node", "c", "t").orderBy("tree", "node").collect():
        model.setdefault(tree, []).extend([] if c is None else [(node, c, t)])
    u, v, cuts = np.asarray([a for a, _ in uv]), np.asarray([b for _, b in uv]), np.asarray(thresholds, float)
    own = spark.sparkContext.broadcast({k: tuple(np.asarray([s[i] for s in splits], np.int64) for i in range(3)) for k, splits in model.items()})
    kept = [c for c in samples.columns if c != vector]
    schema = samples.select(*kept, F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node")).schema

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            e = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            row = np.arange(n)
            for tree, (ids, c, t) in own.value.items():
                node = np.zeros(n, np.int64)
                for _ in range(depth if len(ids) else 0):
                    at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                    left = e[row, u[c[at]]] - e[row, v[c[at]]] < cuts[t[at]]
                    node = np.where(ids[at] == node, 2 * node + np.where(left, 1, 2), node)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.full(n, tree, np.int32)), pa.array(node)], names=[*kept, "tree", "node"])

    return samples.select(*kept, vector).mapInArrow(run, schema)


def in_batch(node: Column, divider: int, number: int) -> Column:
    """Nodes that one of ``divider`` independent runs trains: all near the root, then every ``divider``-th."""
    level = F.length(F.bin(node.cast("long") + 1)) - 1
    return (F.pow(F.lit(2.0), level) < divider) | (node % divider == number)


def pruned(nodes: DataFrame, depth: int) -> DataFrame:
    """A tree cut to ``depth`` levels, to be deepened again: nodes at the last level become leaves."""
    level = F.length(F.bin(F.col("node").cast("long") + 1)) - 1
    kept = nodes.where(level < depth)
    last = level == depth - 1
    return kept.withColumns({k: F.when(last, F.lit(None)).otherwise(F.col(k)) for k in ("c", "t", "gain")}).withColumn("is_leaf", last | F.col("is_leaf"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes and leaves of each level, and the share of its possible nodes."""
    level = F.length(F.bin(F.col("node").cast("long") + 1)) - 1
    by = nodes.groupBy(level.alias("depth")).agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"))
    return by.select("depth", "n_nodes", "n_leaves", F.round(F.col("n_nodes") * 100.0 / F.pow(F.lit(2.0), "depth"), 6).alias("filled"))


def label_histogram(samples: DataFrame) -> DataFrame:
    by = samples.groupBy("label").agg(F.count("*").alias("n"))
    return by.select("label", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def body_bounds(pixels: DataFrame) -> DataFrame:
    body = pixels.where("body")
    return body.groupBy("frame_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count("*").alias("n_body"))


def sample_pixels(pixels: DataFrame, n: int, seed: int) -> DataFrame:
    """n body pixels of each frame, with replacement, by an integer hash of frame and draw."""
    body = pixels.where("body").groupBy("frame_id").agg(F.array_sort(F.collect_list("i")).alias("at"))  # an image at most
    draws = body.select("frame_id", "at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    pick = ((F.col("frame_id") * 7919 + F.col("draw") * 104729 + seed) % 1000003) % F.size("at")
    return draws.select("frame_id", "draw", F.get("at", pick.cast("int")).alias("i")).sortWithinPartitions("frame_id", "i")
