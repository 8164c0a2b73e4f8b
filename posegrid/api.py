"""Short names for the main programs: train, infer, evaluate, track and predict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import TrackingProperties, TrainerProperties
from .operators import cluster, evaluate, forest, history, imaging
from .session import settle
from .sources.adapters import SIDE


@dataclass
class TreeTrainer:
    """Grows one tree from samples (vec_id, label, embedding) with candidates drawn from the properties."""

    properties: TrainerProperties

    def candidates(self, width: int) -> tuple[list[tuple[int, int]], list[float]]:
        p = self.properties
        uv = forest.uv_candidates(p.n_uvs, float(width), p.uv_power, p.seed)
        pairs = [(int(abs(a[0]) * 2) % width, int(abs(a[2]) * 2) % width) for a in uv]
        return pairs, forest.threshold_ladder(p.n_thresholds, p.threshold_range)

    def train(self, samples: DataFrame, width: int = SIDE * SIDE) -> DataFrame:
        pairs, cuts = self.candidates(width)
        return forest.train_tree(samples, pairs, cuts, self.properties.max_depth, settle)


@dataclass
class Forest:
    """Trees (tree, node, c, t, pr) that share candidates and thresholds."""

    nodes: DataFrame
    uv: list[tuple[int, int]]
    thresholds: list[float]
    depth: int

    def infer(self, samples: DataFrame) -> DataFrame:
        """vec_id, pr: the mean of the leaves that the sample reaches."""
        leaves = forest.walk(samples, self.nodes, self.uv, self.thresholds, self.depth)
        return evaluate.mean_leaves(leaves.join(F.broadcast(self.nodes.select("tree", "node", "pr")), ["tree", "node"]), ["vec_id"])

    def labels(self, samples: DataFrame) -> DataFrame:
        return self.infer(samples).select("vec_id", evaluate.argmax_label(F.col("pr")).alias("label"))


def track(pixels: DataFrame, frames: DataFrame, p: TrackingProperties, least_body: float) -> DataFrame:
    """Clusters of each frame as candidate people: cull, cluster, drop tiny, merge, rank (frame_id, root, confidence, place)."""
    z = imaging.near_far(F.col("depth"), p.near, p.far, p.clamp_far)
    kept = pixels.where(z.isNotNull())
    found = cluster.components(frames, least_body, p.cluster_tolerance)
    members = found.join(kept.select("frame_id", "i", "x", "y", "depth"), ["frame_id", "i"])
    merged = cluster.merge_tiny(members, p.tiny_cluster, p.large_cluster)
    people = merged.join(kept.select("frame_id", "i", "x", "y", "depth"), ["frame_id", "i"])
    ranked = cluster.ranked(cluster.centroids(people))
    return ranked.where(F.col("place") <= p.max_people)


def predict(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """State of each key at the requested times, between or at the ends of its frames."""
    return history.bracketed(requests, frames)
