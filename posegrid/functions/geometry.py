"""Scalar geometry as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_power(x: Column, p: float) -> Column:
    """sign(x) * abs(x)^p."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def ladder_step(k: Column) -> Column:
    """Signed step of rung k: 0, 1, -1, 2, -2, ..."""
    half = F.expr("0") + ((k + 1) / 2).cast("int")
    return F.when(k % 2 == 1, half).otherwise(-half)


def node_depth(node: Column) -> Column:
    """Level of a node in a heap-ordered binary tree (root 0)."""
    return F.length(F.bin(node.cast("long") + 1)) - 1


def pixel_metres(metres: Column, resolution: Column | float, fov: Column | float) -> Column:
    """Metres at one metre's distance as pixels, for a vertical field of view in radians."""
    return metres * resolution / (2 * F.tan(F.lit(fov) / 2 if isinstance(fov, float) else fov / 2))


def unproject(x: Column, y: Column, z: Column, fx=8.0, fy=8.0, cx=4.0, cy=4.0) -> tuple[Column, Column]:
    """Camera-space x and y (y up) of a pixel at depth z."""
    return (x - cx) * z / fx, -(y - cy) * z / fy


def project(x: Column, y: Column, z: Column, fx=8.0, fy=8.0, cx=4.0, cy=4.0) -> tuple[Column, Column]:
    return x * fx / z + cx, -y * fy / z + cy


def rigid(m: list[float], x: Column, y: Column, z: Column) -> list[Column]:
    """Row-major 3x4 matrix times a point."""
    return [m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, [x * y for x, y in zip(a, b)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def distance(a: list[Column], b: list[Column]) -> Column:
    return norm([x - y for x, y in zip(a, b)])


def quat_mul(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product of (w, x, y, z)."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def quat_conjugate(q: list[Column]) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def quat_angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two unit rotations in degrees; an undefined one is 0."""
    c = F.least(F.lit(1.0), F.abs(dot(a, b)))
    return F.coalesce(F.nanvl(F.degrees(2 * F.acos(c)), F.lit(0.0)), F.lit(0.0))


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation by the shorter arc; nearly equal rotations are interpolated linearly."""
    d = dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
    sine = F.sin(angle)
    near = sine < 1e-6
    p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / sine)
    q = F.when(near, t).otherwise(F.sin(t * angle) / sine) * sign
    return [x * p + y * q for x, y in zip(a, b)]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def decayed(delta: Column, most: float, decay: float) -> Column:
    """A time step: itself up to ``most``, then a square-root ramp that ends ``most * decay`` further on."""
    over = F.least((F.abs(delta) - most) / (most * decay), F.lit(1.0))
    return F.when(F.abs(delta) <= most, delta).otherwise(F.signum(delta) * (most + most * decay * F.sqrt(over)))


def pose_matrix(q: list[Column], t: list[Column]) -> list[Column]:
    """Row-major 3x4 matrix of a unit quaternion (w, x, y, z) and a translation."""
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), t[0],
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), t[1],
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), t[2],
    ]


def gravity_rotation(g: list[Column]) -> list[Column]:
    """Axis and angle that turn a gravity reading onto (0, -1, 0)."""
    n = norm(g)
    down = [F.lit(0.0), F.lit(-1.0), F.lit(0.0)]
    axis = cross(g, down)
    size = norm(axis)
    return [*[F.when(size > 0, a / size).otherwise(0.0) for a in axis], F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(g, down) / n)))]


def rotate_intrinsics(turn: Column, w: Column, h: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Intrinsics after a turn of 0, 90, 180 or 270 degrees."""
    make = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("width", "height", "fx", "fy", "cx", "cy"))])
    return F.when(turn == 90, make(h, w, fy, fx, cy, w - cx)).when(turn == 180, make(w, h, fx, fy, w - cx, h - cy)).when(turn == 270, make(h, w, fy, fx, h - cy, cx)).otherwise(make(w, h, fx, fy, cx, cy))


def scale_intrinsics(by: float, *values: Column) -> list[Column]:
    return [v / by for v in values]


def undistort_brown(x: Column, y: Column, k1: float, k2: float, k3: float) -> list[Column]:
    """Radial distortion factor applied to normalised image coordinates."""
    r2 = x * x + y * y
    f = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    return [x * f, y * f]


def heat_colour(t: Column) -> list[Column]:
    """Blue, green, red ramp of a value in [0, 1] as 0..255 channels."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    ramp = lambda c: F.round(255 * F.greatest(F.lit(0.0), 1 - F.abs(u - c) * 2)).cast("int")
    return [ramp(1.0), ramp(0.5), ramp(0.0)]
