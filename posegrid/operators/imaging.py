"""Depth image preparation: culling, infill, edges, noise, rotation, projection and quality checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import project, rigid, unproject
from ..sources.adapters import FAR, SIDE

INVALID = 32000  # millimetres that stand for background in training images


def near_far(z: Column, near: float, far: float, clamp: bool) -> Column:
    """Null below ``near`` or where undefined; beyond ``far`` clamped or null."""
    beyond = F.lit(far) if clamp else F.lit(None).cast("double")
    return F.when(z.isNull() | F.isnan(z) | (z < near), F.lit(None).cast("double")).when(z > far, beyond).otherwise(z)


def to_millimetres(m: Column) -> Column:
    return F.when(m >= 1000, INVALID).otherwise(F.round(m * 1000)).cast("int")


def background(d: Column, bg: float = FAR, huge: float = 1000.0) -> Column:
    return F.when(F.isnan(d) | (d >= huge), bg).otherwise(d)


def clamp_background(label: Column, d: Column, bg: float) -> Column:
    """Background pixels, and any beyond it, lie at the background depth."""
    return F.when((label == 0) | (d > bg), bg).otherwise(d)


#: The eight neighbours in scan order.
AROUND = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def neighbourhood(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Adds ``near``, the array of (depth, body) at each offset, null outside.

    Pixels that carry their frame (column ``image``) need no shuffle; others are packed into frames first.
    """
    if "image" in pixels.columns:
        out = pixels
    else:
        whole = pixels.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("i", "depth", "body"))).alias("image"))  # an image at most
        out = pixels.join(whole, "frame_id")
    cell = lambda dx, dy: F.when((F.col("x") + dx).between(0, SIDE - 1) & (F.col("y") + dy).between(0, SIDE - 1), F.get("image", F.greatest(F.lit(0), F.least(F.lit(SIDE * SIDE - 1), F.col("i") + dy * SIDE + dx))))
    return out.withColumn("near", F.array(*[cell(dx, dy) for dx, dy in offsets])).drop("image")


def infill(pixels: DataFrame, seed: int, strict: bool = True) -> DataFrame:
    """Interior pixels take the depth of a neighbour chosen by an integer hash.

    With ``strict`` the rows read are the one above twice, in place of the one below, as the original tool does.
    """
    offsets = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, -1), (0, -1), (1, -1)] if strict else AROUND
    inner = F.col("x").between(1, SIDE - 2) & F.col("y").between(1, SIDE - 2)
    pick = ((F.col("frame_id") * 31 + F.col("i") * 17 + seed) % 8).cast("int")
    return neighbourhood(pixels, offsets).select("frame_id", "x", "y", F.when(inner, F.get("near", pick)["depth"]).otherwise(F.col("depth")).alias("depth"))


def edge_swizzle(pixels: DataFrame, seed: int) -> DataFrame:
    """Body pixels of the interior that touch background take a hashed neighbour's depth and body flag."""
    inner = F.col("x").between(1, SIDE - 2) & F.col("y").between(1, SIDE - 2)
    edge = inner & F.col("body") & F.exists("near", lambda n: ~n["body"])
    pick = ((F.col("frame_id") * 13 + F.col("i") * 29 + seed) % 8).cast("int")
    chosen = F.get("near", pick)
    return neighbourhood(pixels, AROUND).select("frame_id", "x", "y", F.when(edge, chosen["depth"]).otherwise(F.col("depth")).alias("depth"), F.when(edge, chosen["body"]).otherwise(F.col("body")).alias("body"), edge.alias("edge"))


def detect_edges(pixels: DataFrame, least: float = 0.99) -> DataFrame:
    """Points whose gradient over the row or column looks along the eye ray; x is signed, y is absolute."""
    fx = float(SIDE)
    point = lambda z, x, y: [(x - SIDE / 2) * z / fx, -(y - SIDE / 2) * z / fx, z]
    near = neighbourhood(pixels, [(1, 0), (0, 1)])
    x, y, z = F.col("x"), F.col("y"), F.col("depth")
    here = point(z, x, y)
    size = F.sqrt(sum((v * v for v in here[1:]), here[0] * here[0]))

    def along(n: Column, dx: int, dy: int) -> Column:
        to = point(n["depth"], x + dx, y + dy)
        g = [a - b for a, b in zip(to, here)]
        length = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
        return (g[0] * here[0] + g[1] * here[1] + g[2] * here[2]) / (length * size)

    across, down = along(F.get("near", F.lit(0)), 1, 0), F.abs(along(F.get("near", F.lit(1)), 0, 1))
    edge = F.coalesce(across > least, F.lit(True)) | F.coalesce(down > least, F.lit(True))
    return near.select("frame_id", "x", "y", F.round(across, 6).alias("across"), F.round(down, 6).alias("down"), edge.alias("edge"))


def hash_unit(*keys: Column) -> Column:
    """A value in [0, 1) from integer arithmetic that every engine shares."""
    total = keys[0] * 7919
    for k, m in zip(keys[1:], (104729, 15485863)):
        total = total + k * m
    return ((total * 48271) % 2147483647).cast("double") / 2147483647.0


def gaussian_noise(pixels: DataFrame, fwtm_mm: float, seed: int) -> DataFrame:
    """Normal noise whose full width at a tenth of its maximum is given, by Box-Muller on hashed units."""
    u, v = hash_unit(F.col("frame_id") + seed, F.col("i")), hash_unit(F.col("i") + seed, F.col("frame_id"))
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
    return pixels.select("frame_id", "x", "y", (F.col("depth") + z * (fwtm_mm / 4.29193 / 1000)).alias("depth"))


def lattice(n: int = 256, seed: int = 0) -> list[int]:
    """A permutation of 0..n-1 by a linear congruence, shared by all engines."""
    return [(167 * k + 13 + seed) % n for k in range(n)]


def perlin(x: Column, y: Column, period: float, table: list[int]) -> Column:
    """Value noise on a hashed lattice with smooth interpolation, in [0, 1]."""
    n = len(table)
    values = F.array(*[F.lit(v) for v in table])
    fx, fy = x / period, y / period
    x0, y0 = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    s = lambda t: t * t * (3 - 2 * t)
    at = lambda a, b: F.get(values, (F.get(values, b % n) + a) % n) / float(n - 1)
    sx, sy = s(fx - x0), s(fy - y0)
    mix = lambda a, b, t: a + (b - a) * t
    return mix(mix(at(x0, y0), at(x0 + 1, y0), sx), mix(at(x0, y0 + 1), at(x0 + 1, y0 + 1), sx), sy)


def perlin_noise(pixels: DataFrame, period: float, amplitude: float, octaves: int = 2, seed: int = 0) -> DataFrame:
    table = lattice(seed=seed)
    total = sum((perlin(F.col("x") + F.col("frame_id") % 16, F.col("y").cast("double"), period / 2**k, table) * (amplitude / 2**k) for k in range(octaves)), F.lit(0.0))
    return pixels.select("frame_id", "x", "y", F.round(F.col("depth") + total, 6).alias("depth"))


def rotate_image(pixels: DataFrame, turn: int) -> DataFrame:
    """Pixels after a turn of 0, 90, 180 or 270 degrees."""
    x, y, m = F.col("x"), F.col("y"), SIDE - 1
    to = {0: (x, y), 90: (m - y, x), 180: (m - x, m - y), 270: (y, m - x)}[turn]
    return pixels.select("frame_id", to[0].cast("int").alias("x"), to[1].cast("int").alias("y"), "depth")


def downsample(pixels: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel both ways."""
    return pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).select("frame_id", F.expr(f"cast(x div {step} as int)").alias("x"), F.expr(f"cast(y div {step} as int)").alias("y"), "depth")


def point_cloud(pixels: DataFrame) -> DataFrame:
    px, py = unproject(F.col("x"), F.col("y"), F.col("depth"))
    return pixels.select("frame_id", "i", px.alias("px"), py.alias("py"), F.col("depth").alias("pz"))


def transformed(points: DataFrame, matrix: list[float]) -> DataFrame:
    a, b, c = rigid(matrix, F.col("px"), F.col("py"), F.col("pz"))
    return points.select("frame_id", "i", a.alias("px"), b.alias("py"), c.alias("pz"))


def depth_image(points: DataFrame) -> DataFrame:
    """Points seen through the camera: pixels in view, the last point wins where several meet."""
    u, v = project(F.col("px"), F.col("py"), F.col("pz"))
    seen = points.select("frame_id", "i", F.floor(u).cast("int").alias("x"), F.floor(v).cast("int").alias("y"), "pz").where(F.col("x").between(0, SIDE - 1) & F.col("y").between(0, SIDE - 1) & (F.col("pz") > 0))
    return seen.groupBy("frame_id", "x", "y").agg(F.max_by("pz", "i").alias("depth"), F.count("*").alias("n_points"))


def frame_faults(pixels: DataFrame, far: float) -> DataFrame:
    """Counts of what a frame must not have: undefined depths, body beyond the background, no body at all."""
    bad = F.col("depth").isNull() | F.isnan("depth") | (F.col("depth") <= 0)
    by = pixels.groupBy("frame_id").agg(F.sum(bad.cast("long")).alias("n_bad"), F.sum((F.col("body") & (F.col("depth") > far)).cast("long")).alias("n_far"), F.sum(F.col("body").cast("long")).alias("n_body"))
    return by.select("frame_id", "n_bad", "n_far", "n_body", ((F.col("n_bad") == 0) & (F.col("n_far") == 0) & (F.col("n_body") > 0)).alias("ok"))


def focal_point(pixels: DataFrame) -> DataFrame:
    """The median-depth point of the centre box of each frame."""
    box = pixels.where(F.col("x").between(SIDE // 2 - 1, SIDE // 2) & F.col("y").between(SIDE // 2 - 1, SIDE // 2))
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("depth", "i"))
    n = F.count("*").over(Window.partitionBy("frame_id"))
    return box.withColumn("place", place).withColumn("n", n).where(F.col("place") - 1 == F.expr("n div 2")).select("frame_id", "x", "y", "depth")


def xorshift_table(n: int, seed: int = 1) -> list[int]:
    """The first n values of the 32-bit xorshift generator with shifts 13, 17, 5."""
    out, x = [], seed
    for _ in range(n):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out.append(x)
    return out
