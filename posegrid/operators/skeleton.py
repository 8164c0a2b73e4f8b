"""Skeletons: joints, bones, quaternions, validity, reliability, resizing and association."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cross, distance, dot, norm


def joint_scores(probabilities: DataFrame, joint_labels: DataFrame) -> DataFrame:
    """Weight of each pixel for each joint: the joint's label probabilities times depth squared."""
    rows = probabilities.join(F.broadcast(joint_labels), "label")
    return rows.groupBy("frame_id", "i", "joint").agg((F.sum("p") * F.max("depth") * F.max("depth")).alias("weight"))


def joint_pixels(probabilities: DataFrame, joint_labels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels that count for a joint: those where any of its labels (two at most) reaches the joint's threshold."""
    rows = probabilities.join(F.broadcast(joint_labels), "label").join(F.broadcast(thresholds), "joint")
    return rows.where(F.col("p") >= F.col("threshold")).groupBy("frame_id", "i", "joint").agg(F.max("p").alias("p"))


def bones(joints: DataFrame) -> DataFrame:
    """Bones between each joint and the next: length, direction, and rotation from the bone before (w, x, y, z)."""
    w = Window.partitionBy("frame_id").orderBy("joint")
    head = [F.col(c) for c in "xyz"]
    tail = [F.lead(c).over(w) for c in "xyz"]
    rows = joints.select("frame_id", "label", F.col("joint").alias("bone"), (F.col("valid") & F.lead("valid").over(w)).alias("valid"), *[(t - h).alias(f"d{c}") for t, h, c in zip(tail, head, "xyz")]).where("dx is not null")
    length = norm([F.col(f"d{c}") for c in "xyz"])
    rows = rows.withColumn("length", length)
    unit = [F.col(f"d{c}") / F.col("length") for c in "xyz"]
    rows = rows.select("frame_id", "label", "bone", "valid", "length", *[u.alias(f"u{c}") for u, c in zip(unit, "xyz")])
    parent = [F.lag(f"u{c}").over(Window.partitionBy("frame_id").orderBy("bone")).alias(f"p{c}") for c in "xyz"]
    rows = rows.select("*", *parent)
    u, p = [F.col(f"u{c}") for c in "xyz"], [F.col(f"p{c}") for c in "xyz"]
    axis = cross(u, p)
    size = norm(axis)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(u, p))))
    part = lambda a: F.when(size > 0, a / size * F.sin(angle / 2)).otherwise(F.when(p[0].isNotNull(), 0.0))
    return rows.select("frame_id", "label", "bone", "valid", "length", F.when(p[0].isNotNull(), F.cos(angle / 2)).alias("qw"), *[part(a).alias(f"q{c}") for a, c in zip(axis, "xyz")])


def bone_lengths(rows: DataFrame) -> DataFrame:
    return rows.where("valid").groupBy("bone").agg(F.min("length").alias("min_length"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"), F.count("*").alias("n"))


def mean_rotation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean quaternion: each turned to the hemisphere of the key's first one (lowest frame), summed and normalised."""
    q = ["qw", "qx", "qy", "qz"]
    live = rows.where("qw is not null")
    first = live.groupBy(*keys).agg(F.min_by(F.struct(*q), "frame_id").alias("f"))
    side = live.join(F.broadcast(first), keys)
    d = dot([F.col(c) for c in q], [F.col(f"f.{c}") for c in q])
    sums = side.groupBy(*keys).agg(*[F.sum(F.when(d < 0, -F.col(c)).otherwise(F.col(c))).alias(c) for c in q], F.count("*").alias("n"))
    size = norm([F.col(c) for c in q])
    return sums.select(*keys, *[(F.col(c) / size).alias(c) for c in q], "n")


def rotation_radius(rows: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Largest angle in degrees between a key's rotations and their mean."""
    q = ["qw", "qx", "qy", "qz"]
    m = F.broadcast(means.select(*keys, F.struct(*q).alias("m")))
    c = F.least(F.lit(1.0), F.abs(dot([F.col(x) for x in q], [F.col(f"m.{x}") for x in q])))
    return rows.where("qw is not null").join(m, keys).groupBy(*keys).agg(F.max(F.degrees(2 * F.acos(c))).alias("radius"))


def length_violation(rows: DataFrame, limits: DataFrame, factor: float = 1.1) -> DataFrame:
    """Sum over a frame's bones of the squared violation of length limits, and the count of mismatched bones."""
    m = F.broadcast(limits.select("bone", "min_length", "max_length"))
    low, high = F.col("min_length") / factor, F.col("max_length") * factor
    over = F.when(F.col("length") < low, low - F.col("length")).when(F.col("length") > high, F.col("length") - high).otherwise(0.0)
    return rows.join(m, "bone").withColumn("over", F.when(F.col("valid"), over).otherwise(0.0)).groupBy("frame_id").agg(F.sum(F.col("over") * F.col("over")).alias("violation"), F.sum((F.col("over") > 0).cast("long")).alias("n_mismatched"))


def skeleton_difference(joints: DataFrame) -> DataFrame:
    """Mean distance between a frame's joints and the same joints of the frame before, where both have equal validity.

    Two invalid joints count as distance 0. A frame's person is its label.
    """
    w = Window.partitionBy("label", "joint").orderBy("frame_id")
    before = {c: F.lag(c).over(w) for c in ("frame_id", "valid", "x", "y", "z")}
    rows = joints.select("frame_id", "joint", "valid", "x", "y", "z", *[v.alias(f"b_{k}") for k, v in before.items()]).where("b_frame_id is not null and valid = b_valid")
    d = F.when(F.col("valid"), distance([F.col(c) for c in "xyz"], [F.col(f"b_{c}") for c in "xyz"])).otherwise(0.0)
    return rows.groupBy("frame_id").agg(F.avg(d).alias("difference"), F.count("*").alias("n_joints"))


def reliability(joints: DataFrame, frames: int = 6, sigma2: float = 0.25) -> DataFrame:
    """Gaussian-weighted share of the last frames in which a joint was valid; invalid joints of the mean count as 0."""
    w = Window.partitionBy("label", "joint").orderBy("frame_id")
    weights = [2.718281828459045 ** (-((k / frames) ** 2) / (2 * sigma2)) for k in range(frames)]
    terms = [F.coalesce(F.lag(F.col("valid").cast("double"), k).over(w), F.lit(0.0)) * g for k, g in enumerate(weights)]
    score = sum(terms[1:], terms[0]) / sum(weights)
    rows = joints.withColumn("reliability", score)
    return rows.groupBy("frame_id").agg(F.avg(F.when(F.col("valid"), F.col("reliability")).otherwise(0.0)).alias("reliability"))


def resized(joints: DataFrame, lengths: DataFrame, anchor: int = 0) -> DataFrame:
    """Joints moved along a chain so that each bone has its given length; the anchor joint stays where it was.

    Along a chain every joint is the root plus the sum of the scaled bones before it: one window, no recursion.
    """
    w = Window.partitionBy("frame_id").orderBy("joint")
    axes = "xyz"
    step = [F.col(c) - F.lag(c).over(w) for c in axes]
    rows = joints.select("frame_id", "joint", *axes, *[s.alias(f"s{c}") for s, c in zip(step, axes)])
    rows = rows.join(F.broadcast(lengths.select((F.col("bone") + 1).alias("joint"), F.col("mean_length"))), "joint", "left")
    size = norm([F.col(f"s{c}") for c in axes])
    scale = F.when(size > 0, F.col("mean_length") / size).otherwise(0.0)
    moved = [F.sum(F.coalesce(F.col(f"s{c}") * scale, F.lit(0.0))).over(w) for c in axes]
    rows = rows.select("frame_id", "joint", *axes, *[m.alias(f"m{c}") for m, c in zip(moved, axes)])
    whole = Window.partitionBy("frame_id")
    shift = [F.max(F.when(F.col("joint") == anchor, F.col(c) - F.col(f"m{c}"))).over(whole) for c in axes]
    return rows.select("frame_id", "joint", *[(F.col(f"m{c}") + s).alias(c) for s, c in zip(shift, axes)])


def complete(joints: DataFrame) -> DataFrame:
    """Frames all of whose joints are valid, as one array of joints in order."""
    by = joints.groupBy("frame_id").agg(F.min(F.col("valid").cast("int")).alias("ok"), F.array_sort(F.collect_list(F.struct("joint", "x", "y", "z"))).alias("joints"))
    return by.where("ok = 1").select("frame_id", "joints")


def poses_json(frames: DataFrame) -> DataFrame:
    return frames.select("frame_id", F.to_json(F.struct(F.col("frame_id").alias("frame"), F.transform("joints", lambda j: F.struct(j["x"].alias("x"), j["y"].alias("y"), j["z"].alias("z"))).alias("joints"))).alias("json"))


def associate(people: DataFrame, skeletons: DataFrame, threshold: float) -> DataFrame:
    """Greedy nearest association within a group: people in order take the nearest free skeleton within the threshold.

    people: grp, person, px; skeletons: grp, skeleton, sx. The greedy order is part of the result, so each group is
    one ordered fold; groups are frames or places, bounded by what a camera sees.
    """

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        rows = []
        at = right.sort_values(["sx", "skeleton"])
        xs, ids = at["sx"].to_numpy(), at["skeleton"].to_numpy()
        for person, px in left.sort_values("person")[["person", "px"]].itertuples(index=False):
            best = None
            for x, k in zip(xs, ids):
                d = abs(x - px)
                if k not in taken and d <= threshold and (best is None or (d, k) < best):
                    best = (d, k)
            if best:
                taken.add(best[1])
                rows.append((key[0], person, best[1], best[0]))
        return pd.DataFrame(rows, columns=["grp", "person", "skeleton", "away"])

    return people.groupBy("grp").cogroup(skeletons.groupBy("grp")).applyInPandas(fold, "grp long, person long, skeleton long, away double")


def mean_shift(points: DataFrame, steps: int, bandwidth: float) -> DataFrame:
    """Weighted gaussian mean shift within groups: points (grp, id, x, y, z, w) moved ``steps`` times.

    The kernel is summed over the fixed points of the group in blocks of rows: each step is one Arrow pass over the
    groups' own points, so pairs are never materialised as rows.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fixed, weight = pdf[["x", "y", "z"]].to_numpy(float), pdf["w"].to_numpy(float)
        now = fixed.copy()
        for _ in range(steps):
            for at in range(0, len(now), 512):
                d2 = ((now[at : at + 512, None, :] - fixed[None]) ** 2).sum(axis=2)
                k = np.exp(-d2 / (bandwidth * bandwidth)) * weight[None]
                now[at : at + 512] = (k[:, :, None] * fixed[None]).sum(axis=1) / k.sum(axis=1, keepdims=True)
        return pdf[["grp", "id"]].assign(x=now[:, 0], y=now[:, 1], z=now[:, 2])

    return points.groupBy("grp").applyInPandas(run, "grp long, id long, x double, y double, z double")


def grid_best(errors: DataFrame) -> DataFrame:
    """The parameter set of least total error for each joint; the first on ties (joint, combo, error)."""
    total = errors.groupBy("joint", "combo").agg(F.sum(F.least(F.col("error"), F.lit(10.0))).alias("total"))
    return total.groupBy("joint").agg(F.min_by(F.struct("combo", "total"), F.struct(F.round("total", 6), "combo")).alias("b")).select("joint", F.col("b.combo").alias("combo"), F.round("b.total", 6).alias("total"))


def joint_benchmark(truth: DataFrame, inferred: DataFrame, missing: float = 10.0) -> DataFrame:
    """Mean distance and track rate of each joint; a joint that was not inferred is ``missing`` metres off."""
    d = distance([F.col(f"t_{c}") for c in "xyz"], [F.col(c) for c in "xyz"])
    both = truth.select("frame_id", "joint", *[F.col(c).alias(f"t_{c}") for c in "xyz"]).join(inferred, ["frame_id", "joint"], "left")
    return both.groupBy("joint").agg(F.avg(F.coalesce(F.least(d, F.lit(missing)), F.lit(missing))).alias("mean_distance"), F.avg(F.col("x").isNotNull().cast("double")).alias("track_rate"))


def kinematic_ratio(length: Column, mean: Column) -> Column:
    """Likeness of a length to its running mean, in [0, 1]."""
    return F.least(length, mean) / F.greatest(length, mean)


def repaired_rotations(rows: DataFrame, means: DataFrame, radius: float) -> DataFrame:
    """Bone rotations farther than ``radius`` degrees from the bone's mean take the person's (label's) last one within it."""
    q = ["qw", "qx", "qy", "qz"]
    m = F.broadcast(means.select("bone", F.struct(*q).alias("m")))
    near = F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot([F.col(c) for c in q], [F.col(f"m.{c}") for c in q]))))) <= radius
    live = rows.where("qw is not null").join(m, "bone").withColumn("good", near)
    w = Window.partitionBy("label", "bone").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("good"), F.struct(*q)), ignorenulls=True).over(w)
    live = live.withColumn("to", F.when(F.col("good"), F.struct(*q)).otherwise(F.coalesce(last, F.struct(*q))))
    return live.select("frame_id", "bone", *[F.col(f"to.{c}").alias(c) for c in q], (~F.col("good")).alias("repaired"))


def refined(candidates: DataFrame) -> DataFrame:
    """The candidate of each joint that raises the skeleton's mean reliability most.

    The mean is a sum of terms of single joints, so a swap helps exactly if the joint's own term grows: the best
    skeleton takes each joint's most reliable candidate, the better ranked one on ties.
    """
    return candidates.groupBy("frame_id", "joint").agg(F.max_by(F.struct("place", "reliability"), F.struct(F.round("reliability", 9), -F.col("place"))).alias("b")).select("frame_id", "joint", "b.*")


def ring_search(pixels: DataFrame, rings: int) -> DataFrame:
    """The body pixel nearest to its frame's seed (sx, sy, on each of the frame's pixels): by square ring, then in scan order.

    No join: pixels meet their seed in their own row, and a frame's pixels combine before the shuffle, which moves a row
    a frame. A table of seeds is to be joined to whole frames, before they become pixels.
    """
    ring = F.greatest(F.abs(F.col("x") - F.col("sx")), F.abs(F.col("y") - F.col("sy"))).cast("int")
    found = pixels.where("body").select("frame_id", ring.alias("ring"), "i").where(F.col("ring") <= rings)
    return found.groupBy("frame_id").agg(F.min(F.struct("ring", "i")).alias("b")).select("frame_id", "b.*")
