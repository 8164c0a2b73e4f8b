"""Queries of depth image preparation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging
from ..sources.adapters import pixels, with_views

MATRIX = [0.0, -1.0, 0.0, 0.5, 1.0, 0.0, 0.0, -0.25, 0.0, 0.0, 1.0, 0.1]


def unproject(spark, sf_dir):
    return imaging.point_cloud(pixels(spark, sf_dir)).select("frame_id", "i", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz")])


def rigid_transform(spark, sf_dir):
    return imaging.transformed(imaging.point_cloud(pixels(spark, sf_dir)), MATRIX).select("frame_id", "i", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz")])


def project(spark, sf_dir):
    cloud = imaging.point_cloud(pixels(spark, sf_dir)).select("frame_id", "i", (F.col("px") * 0.5 + 0.01).alias("px"), (F.col("py") * 0.5 - 0.01).alias("py"), "pz")
    return imaging.depth_image(cloud).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"), "n_points")


def rotate_image(spark, sf_dir):
    return imaging.rotate_image(pixels(spark, sf_dir), 90).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"))


def downsample(spark, sf_dir):
    return imaging.downsample(pixels(spark, sf_dir), 2).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"))


def near_far_cull(spark, sf_dir):
    d = F.col("depth")
    return pixels(spark, sf_dir).select("frame_id", "i", F.round(imaging.near_far(d, 1.8, 2.2, True), 6).alias("clamped"), F.round(imaging.near_far(d, 1.8, 2.2, False), 6).alias("culled"), imaging.to_millimetres(d).alias("mm"))


def infill3x3(spark, sf_dir):
    return imaging.infill(pixels(spark, sf_dir, image=True), 5).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"))


def edge_swizzle(spark, sf_dir):
    return imaging.edge_swizzle(pixels(spark, sf_dir, image=True), 5).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"), "body", "edge")


def edge_detect(spark, sf_dir):
    return imaging.detect_edges(pixels(spark, sf_dir, image=True), 0.3)


def gaussian_noise(spark, sf_dir):
    return imaging.gaussian_noise(pixels(spark, sf_dir), 40.0, 7).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"))


def perlin_noise(spark, sf_dir):
    return imaging.perlin_noise(pixels(spark, sf_dir), 4.0, 0.05)


def validate_frames(spark, sf_dir):
    return imaging.frame_faults(pixels(spark, sf_dir), 2.3)


def focal_point(spark, sf_dir):
    return imaging.focal_point(pixels(spark, sf_dir)).select("frame_id", "x", "y", F.round("depth", 6).alias("depth"))


def clamp_depth(spark, sf_dir):
    label = F.when(F.col("body"), 1).otherwise(0)
    return pixels(spark, sf_dir).select("frame_id", "i", F.round(imaging.clamp_background(label, F.col("depth"), 2.15), 6).alias("depth"))


def _near_sql(offsets) -> str:
    cells = ", ".join(f"CASE WHEN x + {dx} BETWEEN 0 AND 7 AND y + {dy} BETWEEN 0 AND 7 THEN img[i + {dy * 8 + dx} + 1] END" for dx, dy in offsets)
    return f", img AS (SELECT frame_id, list({{'d': depth, 'b': body}} ORDER BY i) AS img FROM patch GROUP BY frame_id), n AS (SELECT p.*, [{cells}] AS near FROM patch p JOIN img USING (frame_id))"


_ABOVE_TWICE = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, -1), (0, -1), (1, -1)]
_INNER = "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6"


def _edge_sql() -> str:
    here = ["((x - 4e0) * depth / 8e0)", "(-(y - 4e0) * depth / 8e0)", "depth"]

    def along(n: str, dx: int, dy: int) -> str:
        to = [f"((x + {dx} - 4e0) * {n}.d / 8e0)", f"(-(y + {dy} - 4e0) * {n}.d / 8e0)", f"{n}.d"]
        g = [f"({a} - {b})" for a, b in zip(to, here)]
        size = lambda v: f"sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]} + {v[2]} * {v[2]})"
        return f"(({g[0]} * {here[0]} + {g[1]} * {here[1]} + {g[2]} * {here[2]}) / ({size(g)} * {size(here)}))"

    return with_views(_near_sql([(1, 0), (0, 1)]) + f", e AS (SELECT frame_id, x, y, {along('near[1]', 1, 0)} AS a, abs({along('near[2]', 0, 1)}) AS b FROM n) SELECT frame_id, x, y, round(a, 6) AS across, round(b, 6) AS down, coalesce(a > 3e-1, true) OR coalesce(b > 3e-1, true) AS edge FROM e", "patch")


_UNIT = "(CAST(((({0}) * 7919 + ({1}) * 104729) * 48271) % 2147483647 AS DOUBLE) / 2147483647e0)"


def _perlin_sql(period: float, amplitude: float, octaves: int) -> str:
    table = imaging.lattice()
    n, terms = len(table), []
    for k in range(octaves):
        fx, fy = f"((x + frame_id % 16) / {period / 2**k!r}e0)", f"(y / {period / 2**k!r}e0)"
        x0, y0 = f"CAST(floor({fx}) AS INT)", f"CAST(floor({fy}) AS INT)"
        s = lambda t: f"({t}) * ({t}) * (3 - 2 * ({t}))"
        at = lambda a, b: f"(t[(t[({b}) % {n} + 1] + {a}) % {n} + 1] / {n - 1}e0)"
        sx, sy = s(f"{fx} - {x0}"), s(f"{fy} - {y0}")
        mix = lambda a, b, t: f"({a} + ({b} - {a}) * ({t}))"
        terms.append(f"{mix(mix(at(x0, y0), at(f'({x0} + 1)', y0), sx), mix(at(x0, f'{y0} + 1'), at(f'({x0} + 1)', f'{y0} + 1'), sx), sy)} * {amplitude / 2**k!r}e0")
    return with_views(f", lat AS (SELECT {table} AS t) SELECT frame_id, x, y, round(depth + {' + '.join(terms)}, 6) AS depth FROM patch, lat", "patch")


_POINTS = ", cloud AS (SELECT frame_id, i, (x - 4e0) * depth / 8e0 AS px, -(y - 4e0) * depth / 8e0 AS py, depth AS pz FROM patch)"

ORACLES = {
    "unproject": with_views(_POINTS + " SELECT frame_id, i, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM cloud", "patch"),
    "rigid_transform": with_views(_POINTS + " SELECT frame_id, i, round(0e0 * px + -1e0 * py + 0e0 * pz + 5e-1, 6) AS px, round(1e0 * px + 0e0 * py + 0e0 * pz - 25e-2, 6) AS py, round(0e0 * px + 0e0 * py + 1e0 * pz + 1e-1, 6) AS pz FROM cloud", "patch"),
    "project": with_views(_POINTS + ", v AS (SELECT frame_id, i, CAST(floor((px * 5e-1 + 1e-2) * 8e0 / pz + 4e0) AS INT) AS x, CAST(floor(-(py * 5e-1 - 1e-2) * 8e0 / pz + 4e0) AS INT) AS y, pz FROM cloud) SELECT frame_id, x, y, round(arg_max(pz, i), 6) AS depth, count(*) AS n_points FROM v WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY frame_id, x, y", "patch"),
    "rotate_image": with_views(" SELECT frame_id, CAST(7 - y AS INT) AS x, x AS y, round(depth, 6) AS depth FROM patch", "patch"),
    "downsample": with_views(" SELECT frame_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, round(depth, 6) AS depth FROM patch WHERE x % 2 = 0 AND y % 2 = 0", "patch"),
    "near_far_cull": with_views(" SELECT frame_id, i, round(CASE WHEN depth >= 18e-1 THEN least(depth, 22e-1) END, 6) AS clamped, round(CASE WHEN depth BETWEEN 18e-1 AND 22e-1 THEN depth END, 6) AS culled, CAST(round(depth * 1000) AS INT) AS mm FROM patch", "patch"),
    "infill3x3": with_views(_near_sql(_ABOVE_TWICE) + f" SELECT frame_id, x, y, round(CASE WHEN {_INNER} THEN near[(frame_id * 31 + i * 17 + 5) % 8 + 1].d ELSE depth END, 6) AS depth FROM n", "patch"),
    "edge_swizzle": with_views(_near_sql(imaging.AROUND) + f", e AS (SELECT *, {_INNER} AND body AND len(list_filter(near, lambda k: NOT k.b)) > 0 AS edge, near[(frame_id * 13 + i * 29 + 5) % 8 + 1] AS pick FROM n) SELECT frame_id, x, y, round(CASE WHEN edge THEN pick.d ELSE depth END, 6) AS depth, CASE WHEN edge THEN pick.b ELSE body END AS body, edge FROM e", "patch"),
    "edge_detect": _edge_sql(),
    "gaussian_noise": with_views(f" SELECT frame_id, x, y, round(depth + sqrt(-2 * ln(1 - {_UNIT.format('frame_id + 7', 'i')})) * cos(2e0 * pi() * {_UNIT.format('i + 7', 'frame_id')}) * (40e0 / 4.29193e0 / 1000), 6) AS depth FROM patch", "patch"),
    "perlin_noise": _perlin_sql(4.0, 0.05, 2),
    "validate_frames": with_views(", f AS (SELECT frame_id, CAST(sum(CASE WHEN depth IS NULL OR isnan(depth) OR depth <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad, CAST(sum(CASE WHEN body AND depth > 23e-1 THEN 1 ELSE 0 END) AS BIGINT) AS n_far, CAST(sum(CASE WHEN body THEN 1 ELSE 0 END) AS BIGINT) AS n_body FROM patch GROUP BY frame_id) SELECT *, n_bad = 0 AND n_far = 0 AND n_body > 0 AS ok FROM f", "patch"),
    "focal_point": with_views(" SELECT frame_id, x, y, round(depth, 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY depth, i) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM patch WHERE x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4) b WHERE k = n // 2", "patch"),
    "clamp_depth": with_views(" SELECT frame_id, i, round(CASE WHEN NOT body OR depth > 215e-2 THEN 215e-2 ELSE depth END, 6) AS depth FROM patch", "patch"),
}

QUERIES = {f.__name__: f for f in (unproject, rigid_transform, project, rotate_image, downsample, near_far_cull, infill3x3, edge_swizzle, edge_detect, gaussian_noise, perlin_noise, validate_frames, focal_point, clamp_depth)}
