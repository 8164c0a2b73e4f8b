"""Queries of joints, bones, association and parameter search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..operators import skeleton
from ..sources.adapters import joints, literal_table, pixels, table, with_views

JOINT_LABELS = [(0, 0), (0, 1), (1, 2), (2, 3)]
GRID = [(0, 0.0), (1, 0.02), (2, 0.05)]


def _probabilities(spark, sf_dir):
    v = F.col("value")
    return pixels(spark, sf_dir).select("frame_id", "i", "depth", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (1 / (1 + (v * 10 - k) * (v * 10 - k))).alias("p")) for k in range(4)])).alias("q")).select("frame_id", "i", "depth", "q.*")


def joint_pixels(spark, sf_dir):
    limits = literal_table(spark, [(0, 0.75), (1, 0.5), (2, 0.25)], "joint int, threshold double")
    found = skeleton.joint_pixels(_probabilities(spark, sf_dir), literal_table(spark, JOINT_LABELS, "joint int, label int"), limits)
    return found.select("frame_id", "i", "joint", F.round("p", 6).alias("p"))


def joint_weights(spark, sf_dir):
    rows = _probabilities(spark, sf_dir)
    return skeleton.joint_scores(rows, literal_table(spark, JOINT_LABELS, "joint int, label int")).select("frame_id", "i", "joint", F.round("weight", 6).alias("weight"))


def bone_geometry(spark, sf_dir):
    rows = skeleton.bones(joints(spark, sf_dir))
    return rows.select("frame_id", "bone", "valid", *[F.round(c, 6).alias(c) for c in ("length", "qw", "qx", "qy", "qz")])


def bone_lengths(spark, sf_dir):
    return skeleton.bone_lengths(skeleton.bones(joints(spark, sf_dir))).select("bone", *[F.round(c, 6).alias(c) for c in ("min_length", "mean_length", "max_length")], "n")


def quat_mean(spark, sf_dir):
    return skeleton.mean_rotation(skeleton.bones(joints(spark, sf_dir)), ["bone"]).select("bone", *[F.round(c, 6).alias(c) for c in ("qw", "qx", "qy", "qz")], "n")


def quat_radius(spark, sf_dir):
    rows = skeleton.bones(joints(spark, sf_dir))
    return skeleton.rotation_radius(rows, skeleton.mean_rotation(rows, ["bone"]), ["bone"]).select("bone", F.round("radius", 4).alias("radius"))


def skeleton_validation(spark, sf_dir):
    rows = skeleton.bones(joints(spark, sf_dir))
    limits = literal_table(spark, [(b, 0.15, 0.25) for b in range(13)], "bone int, min_length double, max_length double")
    return skeleton.length_violation(rows, limits).select("frame_id", F.round("violation", 6).alias("violation"), "n_mismatched", (F.round("violation", 6) <= 0.15).alias("ok"))


def skeleton_diff(spark, sf_dir):
    return skeleton.skeleton_difference(joints(spark, sf_dir)).select("frame_id", F.round("difference", 6).alias("difference"), "n_joints")


def skeleton_reliability(spark, sf_dir):
    return skeleton.reliability(joints(spark, sf_dir)).select("frame_id", F.round("reliability", 6).alias("reliability"))


def skeleton_resize(spark, sf_dir):
    lengths = literal_table(spark, [(b, 0.1 + 0.01 * b) for b in range(13)], "bone int, mean_length double")
    return skeleton.resized(joints(spark, sf_dir), lengths, 3).select("frame_id", "joint", *[F.round(c, 6).alias(c) for c in "xyz"])


def pose_export(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    by = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.col("text").isNotNull().cast("int")).alias("ok"), F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return by.where("ok = 1 and last + 1 = n").select("conv_id", "n", F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


def complete_skeletons(spark, sf_dir):
    return skeleton.poses_json(skeleton.complete(joints(spark, sf_dir)))


def person_assoc(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("grp"), F.col("s_suppkey").alias("person"), F.col("s_acctbal").alias("px"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_custkey").alias("skeleton"), F.col("c_acctbal").alias("sx"))
    return skeleton.associate(people, seen, 500.0).select("grp", "person", "skeleton", F.round("away", 4).alias("away"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")], (F.get("embedding", F.lit(3)).cast("double") + 1).alias("w"))


def mean_shift_step(spark, sf_dir):
    return skeleton.mean_shift(_points(spark, sf_dir), 1, 0.1).select("grp", "id", *[F.round(c, 4).alias(c) for c in "xyz"])


def mean_shift_5(spark, sf_dir):
    return skeleton.mean_shift(_points(spark, sf_dir), 5, 0.1).select("grp", "id", *[F.round(c, 4).alias(c) for c in "xyz"])


def param_grid_best(spark, sf_dir):
    grid = F.broadcast(literal_table(spark, GRID, "combo int, shift double"))
    j = joints(spark, sf_dir)
    error = distance([F.col("x") + F.col("shift"), F.col("y"), F.col("z")], [F.lit(0.03), F.col("joint") * 0.001, F.lit(0.0)])
    return skeleton.grid_best(j.crossJoin(grid).select("frame_id", "joint", "combo", F.when(F.col("valid"), error).otherwise(10.0).alias("error")))


def joint_benchmark(spark, sf_dir):
    j = joints(spark, sf_dir)
    seen = j.where("valid").select("frame_id", "joint", (F.col("x") + 0.01).alias("x"), "y", (F.col("z") - 0.02 * F.col("joint")).alias("z"))
    return skeleton.joint_benchmark(j, seen).select("joint", F.round("mean_distance", 6).alias("mean_distance"), F.round("track_rate", 6).alias("track_rate"))


_BONES = """, d AS (SELECT frame_id, label, joint AS bone, valid AND lead(valid) OVER w AS valid, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM joints WINDOW w AS (PARTITION BY frame_id ORDER BY joint)),
u AS (SELECT frame_id, label, bone, valid, length, dx / length AS ux, dy / length AS uy, dz / length AS uz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS length FROM d WHERE dx IS NOT NULL) a),
p AS (SELECT *, lag(ux) OVER w AS px, lag(uy) OVER w AS py, lag(uz) OVER w AS pz FROM u WINDOW w AS (PARTITION BY frame_id ORDER BY bone)),
x AS (SELECT *, uy * pz - uz * py AS ax, uz * px - ux * pz AS ay, ux * py - uy * px AS az, acos(least(1e0, greatest(-1e0, ux * px + uy * py + uz * pz))) AS angle FROM p WHERE px IS NOT NULL
    UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM p WHERE px IS NULL),
s AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS size FROM x),
bones AS (SELECT frame_id, label, bone, valid, length, cos(angle / 2) AS qw, CASE WHEN size > 0 THEN ax / size * sin(angle / 2) WHEN px IS NOT NULL THEN 0e0 END AS qx, CASE WHEN size > 0 THEN ay / size * sin(angle / 2) WHEN px IS NOT NULL THEN 0e0 END AS qy, CASE WHEN size > 0 THEN az / size * sin(angle / 2) WHEN px IS NOT NULL THEN 0e0 END AS qz FROM s)"""
_MEAN = """, live AS (SELECT * FROM bones WHERE qw IS NOT NULL), f AS (SELECT bone, qw AS fw, qx AS fx, qy AS fy, qz AS fz FROM (SELECT *, row_number() OVER (PARTITION BY bone ORDER BY frame_id) AS k FROM live) a WHERE k = 1),
g AS (SELECT l.*, CASE WHEN qw * fw + qx * fx + qy * fy + qz * fz < 0 THEN -1 ELSE 1 END AS h FROM live l JOIN f USING (bone)),
t AS (SELECT bone, sum(h * qw) AS qw, sum(h * qx) AS qx, sum(h * qy) AS qy, sum(h * qz) AS qz, count(*) AS n FROM g GROUP BY bone),
m AS (SELECT bone, qw / r AS qw, qx / r AS qx, qy / r AS qy, qz / r AS qz, n FROM (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS r FROM t) a)"""


def _shift_sql(steps: int) -> str:
    out = "WITH s0 AS (SELECT CAST(label AS BIGINT) AS grp, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) + 1 AS w FROM embeddings)"
    for k in range(steps):
        e = "exp(-((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) / 1e-2) * b.w"
        out += f", s{k + 1} AS (SELECT a.grp, a.id, " + ", ".join(f"sum({e} * b.{c}) / sum({e}) AS {c}" for c in "xyz") + f" FROM s{k} a JOIN s0 b ON a.grp = b.grp GROUP BY a.grp, a.id)"
    return out + f" SELECT grp, id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM s{steps}"


_WEIGHTS = [2.718281828459045 ** (-((k / 6) ** 2) / 0.5) for k in range(6)]


def _joints(sql: str) -> str:
    return with_views(sql, "joints")


ORACLES = {
    "joint_pixels": with_views(""", q AS (SELECT frame_id, i, CAST(k AS INT) AS label, 1 / (1 + (value * 10 - k) * (value * 10 - k)) AS p FROM patch, range(4) r(k)),
        j AS (SELECT * FROM (VALUES (0, 0, 75e-2), (0, 1, 75e-2), (1, 2, 5e-1), (2, 3, 25e-2)) v(joint, label, threshold))
        SELECT frame_id, i, joint, round(max(p), 6) AS p FROM q JOIN j USING (label) WHERE p >= threshold GROUP BY frame_id, i, joint""", "patch"),
    "joint_weights": with_views(", q AS (SELECT frame_id, i, depth, CAST(k AS INT) AS label, 1 / (1 + (value * 10 - k) * (value * 10 - k)) AS p FROM patch, range(4) r(k)), j AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 2), (2, 3)) v(joint, label)) SELECT frame_id, i, joint, round(sum(p) * max(depth) * max(depth), 6) AS weight FROM q JOIN j USING (label) GROUP BY frame_id, i, joint", "patch"),
    "bone_geometry": _joints(_BONES + " SELECT frame_id, bone, valid, round(length, 6) AS length, round(qw, 6) AS qw, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM bones"),
    "bone_lengths": _joints(_BONES + " SELECT bone, round(min(length), 6) AS min_length, round(avg(length), 6) AS mean_length, round(max(length), 6) AS max_length, count(*) AS n FROM bones WHERE valid GROUP BY bone"),
    "quat_mean": _joints(_BONES + _MEAN + " SELECT bone, round(qw, 6) AS qw, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz, n FROM m"),
    "quat_radius": _joints(_BONES + _MEAN + " SELECT l.bone, round(max(degrees(2 * acos(least(1e0, abs(l.qw * m.qw + l.qx * m.qx + l.qy * m.qy + l.qz * m.qz))))), 4) AS radius FROM live l JOIN m USING (bone) GROUP BY l.bone"),
    "skeleton_validation": _joints(_BONES + ", o AS (SELECT frame_id, CASE WHEN NOT valid THEN 0e0 WHEN length < 15e-2 / 11e-1 THEN 15e-2 / 11e-1 - length WHEN length > 25e-2 * 11e-1 THEN length - 25e-2 * 11e-1 ELSE 0e0 END AS o FROM bones) SELECT frame_id, round(sum(o * o), 6) AS violation, CAST(sum(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatched, round(sum(o * o), 6) <= 15e-2 AS ok FROM o GROUP BY frame_id"),
    "skeleton_diff": _joints(", b AS (SELECT *, lag(frame_id) OVER w AS bf, lag(valid) OVER w AS bv, lag(x) OVER w AS bx, lag(y) OVER w AS \"by\", lag(z) OVER w AS bz FROM joints WINDOW w AS (PARTITION BY label, joint ORDER BY frame_id)) SELECT frame_id, round(avg(CASE WHEN valid THEN sqrt((x - bx) * (x - bx) + (y - \"by\") * (y - \"by\") + (z - bz) * (z - bz)) ELSE 0e0 END), 6) AS difference, count(*) AS n_joints FROM b WHERE bf IS NOT NULL AND valid = bv GROUP BY frame_id"),
    "skeleton_reliability": _joints(", r AS (SELECT frame_id, label, joint, valid, (" + " + ".join(f"coalesce(lag(CAST(valid AS DOUBLE), {k}) OVER w, 0e0) * {g!r}e0" for k, g in enumerate(_WEIGHTS)) + f") / {sum(_WEIGHTS)!r}e0 AS rel FROM joints WINDOW w AS (PARTITION BY label, joint ORDER BY frame_id)) SELECT frame_id, round(avg(CASE WHEN valid THEN rel ELSE 0e0 END), 6) AS reliability FROM r GROUP BY frame_id"),
    "skeleton_resize": _joints(", s AS (SELECT *, x - lag(x) OVER w AS sx, y - lag(y) OVER w AS sy, z - lag(z) OVER w AS sz FROM joints WINDOW w AS (PARTITION BY frame_id ORDER BY joint)), k AS (SELECT *, CASE WHEN sqrt(sx * sx + sy * sy + sz * sz) > 0 THEN (1e-1 + 1e-2 * (joint - 1)) / sqrt(sx * sx + sy * sy + sz * sz) ELSE 0e0 END AS f FROM s), m AS (SELECT frame_id, joint, x, y, z, " + ", ".join(f"sum(coalesce(s{c} * f, 0e0)) OVER w AS m{c}" for c in "xyz") + " FROM k WINDOW w AS (PARTITION BY frame_id ORDER BY joint)), a AS (SELECT frame_id, x - mx AS ox, y - my AS oy, z - mz AS oz FROM m WHERE joint = 3) SELECT frame_id, joint, round(mx + ox, 6) AS x, round(my + oy, 6) AS y, round(mz + oz, 6) AS z FROM m JOIN a USING (frame_id)"),
    "pose_export": "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id HAVING min(CASE WHEN text IS NULL THEN 0 ELSE 1 END) = 1 AND max(turn) + 1 = count(*)",
    "person_assoc": """WITH RECURSIVE p AS (SELECT CAST(s_nationkey AS BIGINT) AS grp, s_suppkey AS person, s_acctbal AS px, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
        g(grp, k, taken, person, skeleton, away) AS (SELECT DISTINCT grp, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM p
        UNION ALL SELECT grp, k, CASE WHEN b.s IS NULL THEN taken ELSE list_append(taken, b.s) END, person, b.s, b.d FROM (SELECT g.grp, p.k, g.taken, p.person, (SELECT {'s': c_custkey, 'd': abs(c_acctbal - p.px)} FROM customer WHERE c_nationkey = g.grp AND abs(c_acctbal - p.px) <= 500 AND NOT list_contains(g.taken, c_custkey) ORDER BY abs(c_acctbal - p.px), c_custkey LIMIT 1) AS b FROM g JOIN p ON p.grp = g.grp AND p.k = g.k + 1) x)
        SELECT grp, person, skeleton, round(away, 4) AS away FROM g WHERE skeleton IS NOT NULL""",
    "mean_shift_step": _shift_sql(1),
    "mean_shift_5": _shift_sql(5),
    "param_grid_best": _joints(", g AS (SELECT * FROM (VALUES (0, 0e0), (1, 2e-2), (2, 5e-2)) v(combo, shift)), e AS (SELECT joint, combo, sum(least(CASE WHEN valid THEN sqrt((x + shift - 3e-2) * (x + shift - 3e-2) + (y - joint * 1e-3) * (y - joint * 1e-3) + z * z) ELSE 1e1 END, 1e1)) AS total FROM joints, g GROUP BY joint, combo) SELECT joint, combo, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY joint ORDER BY round(total, 6), combo) AS k FROM e) a WHERE k = 1"),
    "joint_benchmark": _joints(" SELECT joint, round(avg(CASE WHEN valid THEN least(sqrt(1e-2 * 1e-2 + (2e-2 * joint) * (2e-2 * joint)), 1e1) ELSE 1e1 END), 6) AS mean_distance, round(avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END), 6) AS track_rate FROM joints GROUP BY joint"),
}

QUERIES = {f.__name__: f for f in (joint_pixels, joint_weights, bone_geometry, bone_lengths, quat_mean, quat_radius, skeleton_validation, skeleton_diff, skeleton_reliability, skeleton_resize, pose_export, complete_skeletons, person_assoc, mean_shift_step, mean_shift_5, param_grid_best, joint_benchmark)}
