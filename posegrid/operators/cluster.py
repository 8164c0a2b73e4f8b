"""Components, floods and clusters of pixels in depth frames.

A frame is bounded, so whole frames go through Arrow in batches and numpy labels them; frames are independent, so
there is no shuffle but that which packs pixels into frames.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.adapters import SIDE


def scanline_runs(pixels: DataFrame) -> DataFrame:
    """Runs of body pixels along a row: frame_id, y, left, right (gaps and islands)."""
    spot = F.row_number().over(Window.partitionBy("frame_id", "y").orderBy("x"))
    island = pixels.where("body").withColumn("island", F.col("x") - spot)
    return island.groupBy("frame_id", "y", "island").agg(F.min("x").alias("left"), F.max("x").alias("right")).drop("island")


def touching_runs(runs: DataFrame) -> DataFrame:
    """Pairs of runs on adjacent rows that share a column."""
    below = runs.select("frame_id", (F.col("y") - 1).alias("y"), F.col("left").alias("b_left"), F.col("right").alias("b_right"))
    return runs.join(below, ["frame_id", "y"]).where("left <= b_right and right >= b_left")


def _label(mask: np.ndarray, joins) -> np.ndarray:
    """Component root (smallest pixel) of each set pixel, -1 elsewhere; ``joins(a, b)`` says if two touching pixels do."""
    side = mask.shape[0]
    root = np.where(mask.ravel(), np.arange(side * side), -1)

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for i in np.flatnonzero(root >= 0).tolist():
        for j in (i - 1 if i % side else -1, i - side):
            if j >= 0 and root[j] >= 0 and joins(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return np.array([top(i) if r >= 0 else -1 for i, r in enumerate(root)])


def _per_image(frames: DataFrame, work, schema: str) -> DataFrame:
    """``work(frame_id, depth array)`` for each frame of (frame_id, depth); its rows, batched."""
    ship(frames.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for frame_id, depth in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += work(frame_id, np.asarray(depth.values.to_numpy(zero_copy_only=False)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return frames.select("frame_id", "depth").mapInArrow(run, schema)


def components(frames: DataFrame, least: float, tolerance: float | None = None) -> DataFrame:
    """4-neighbour components of pixels deeper than ``least``: frame_id, i, root.

    With a tolerance, touching pixels join only if their depths differ by less.
    """

    def work(frame_id, depth):
        side = SIDE
        joins = (lambda a, b: True) if tolerance is None else (lambda a, b: abs(depth[a] - depth[b]) < tolerance)
        root = _label((depth > least).reshape(side, side), joins)
        return [(frame_id, int(i), int(root[i])) for i in np.flatnonzero(root >= 0)]

    return _per_image(frames, work, "frame_id long, i int, root int")


def flood(frames: DataFrame, tolerance: float, seed: int) -> DataFrame:
    """Pixels reached from a seed over 4-neighbours: a nearer one always joins, a farther one within the tolerance."""

    def work(frame_id, depth):
        seen, todo = {seed}, deque([seed])
        while todo:
            a = todo.popleft()
            for b in ((a - 1) if a % SIDE else -1, (a + 1) if a % SIDE < SIDE - 1 else -1, a - SIDE, a + SIDE):
                if 0 <= b < SIDE * SIDE and b not in seen and depth[b] - depth[a] < tolerance and b // SIDE >= seed // SIDE:
                    seen.add(b)
                    todo.append(b)
        return [(frame_id, i) for i in sorted(seen)]

    return _per_image(frames, work, "frame_id long, i int")


def boxes(members: DataFrame) -> DataFrame:
    """Size and bounds of each cluster; members have frame_id, root, x, y, depth."""
    return members.groupBy("frame_id", "root").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.min("depth").alias("min_z"), F.max("depth").alias("max_z"))


def of_size(clusters: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Clusters whose width, height and depth lie within bounds (drops below least or above most)."""
    size = {"w": F.col("max_x") - F.col("min_x") + 1, "h": F.col("max_y") - F.col("min_y") + 1, "d": F.col("max_z") - F.col("min_z")}
    for k, v in size.items():
        clusters = clusters.where(~(v < least.get(k, 0.0)) & ~(v > most.get(k, 1e9)))
    return clusters


def merge_tiny(members: DataFrame, tiny: int, large: int) -> DataFrame:
    """Tiny clusters join the large cluster on their left or top, the lowest root first; frame_id, i, root."""
    sized = members.withColumn("n", F.count("*").over(Window.partitionBy("frame_id", "root")))
    big = sized.where(F.col("n") >= large).select("frame_id", F.col("i").alias("j"), F.col("root").alias("big"))
    small = sized.where((F.col("n") < tiny) & (F.col("x") > 0) & (F.col("y") > 0))
    near = small.select("frame_id", F.col("root"), F.explode(F.array(F.col("i") - 1, F.col("i") - SIDE)).alias("j"))
    to = near.join(big, ["frame_id", "j"]).groupBy("frame_id", "root").agg(F.min("big").alias("to"))
    return sized.join(to, ["frame_id", "root"], "left").select("frame_id", "i", F.coalesce("to", "root").alias("root"))


def overlapping(clusters: DataFrame) -> DataFrame:
    """Pairs of clusters of a frame whose image boxes overlap (a frame's clusters are at most its pixels)."""
    a, b = clusters.alias("a"), clusters.alias("b")
    meet = "a.min_x <= b.max_x and b.min_x <= a.max_x and a.min_y <= b.max_y and b.min_y <= a.max_y"
    return a.join(b, F.expr(f"a.frame_id = b.frame_id and a.root < b.root and {meet}")).select("a.frame_id", F.col("a.root").alias("a_root"), F.col("b.root").alias("b_root"))


def centroids(members: DataFrame, weight: str = "depth") -> DataFrame:
    """Confidence (sum of weights) and rounded mean pixel of each cluster."""
    return members.groupBy("frame_id", "root").agg(F.sum(weight).alias("confidence"), F.round(F.avg("x")).cast("int").alias("cx"), F.round(F.avg("y")).cast("int").alias("cy"))


def nearest_members(members: DataFrame, centres: DataFrame) -> DataFrame:
    """The member nearest to its cluster's rounded centre, the first in scan order on ties."""
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return members.join(centres.select("frame_id", "root", "cx", "cy"), ["frame_id", "root"]).groupBy("frame_id", "root").agg(F.min_by("i", F.struct(d2.alias("d2"), "i")).alias("i"))


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates of a frame, the most confident first."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc(F.round("confidence", 6)), "root")))


def add_back(members: DataFrame, loose: DataFrame, tolerance: float, rounds: int = 1) -> DataFrame:
    """Loose pixels join a 4-neighbour's cluster if their depths differ by less than the tolerance."""
    for _ in range(rounds):
        beside = members.select("frame_id", F.col("root"), F.col("depth").alias("near"), F.explode(F.array(F.struct((F.col("x") - 1).alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") - 1).alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))).alias("to")).select("frame_id", "root", "near", "to.*")
        found = loose.join(beside, ["frame_id", "x", "y"]).where(F.abs(F.col("depth") - F.col("near")) < tolerance).groupBy("frame_id", "x", "y", "i", "depth").agg(F.min("root").alias("root"))
        members = members.select("frame_id", "x", "y", "i", "depth", "root").unionByName(found)
        loose = loose.join(found.select("frame_id", "i"), ["frame_id", "i"], "left_anti")
    return members
