"""Queries of runs, components, floods and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster
from ..sources.adapters import BASE_DEPTH, BODY, images, pixels, with_views


def _members(spark, sf_dir):
    frames = images(spark, sf_dir)
    found = cluster.components(frames.withColumn("depth", F.transform("depth", lambda d: d - BASE_DEPTH)), BODY)
    return found.join(pixels(spark, sf_dir).select("frame_id", "i", "x", "y", "depth"), ["frame_id", "i"])


def scanline_runs(spark, sf_dir):
    return cluster.scanline_runs(pixels(spark, sf_dir))


def touching_runs(spark, sf_dir):
    return cluster.touching_runs(cluster.scanline_runs(pixels(spark, sf_dir))).select("frame_id", "y", "left", "right", "b_left", "b_right")


def connected_components(spark, sf_dir):
    return _members(spark, sf_dir).select("frame_id", "i", "root")


def component_centroid(spark, sf_dir):
    return cluster.centroids(_members(spark, sf_dir)).select("frame_id", "root", F.round("confidence", 6).alias("confidence"), "cx", "cy")


def nearest_member(spark, sf_dir):
    m = _members(spark, sf_dir)
    return cluster.nearest_members(m, cluster.centroids(m))


def component_confidence(spark, sf_dir):
    return cluster.ranked(cluster.centroids(_members(spark, sf_dir))).select("frame_id", "root", F.round("confidence", 6).alias("confidence"), "place")


def flood_fill(spark, sf_dir):
    return cluster.flood(images(spark, sf_dir), 0.08, 11)


def cluster_bbox_filter(spark, sf_dir):
    return cluster.of_size(cluster.boxes(_members(spark, sf_dir)), {"w": 2, "h": 2}, {"w": 5, "h": 5}).select("frame_id", "root", "n", "min_x", "max_x", "min_y", "max_y")


def tiny_merge(spark, sf_dir):
    return cluster.merge_tiny(_members(spark, sf_dir), 2, 3)


def bbox_overlap_merge(spark, sf_dir):
    return cluster.overlapping(cluster.boxes(_members(spark, sf_dir)))


def add_back_edges(spark, sf_dir):
    members = _members(spark, sf_dir)
    loose = pixels(spark, sf_dir).where("NOT body").select("frame_id", "x", "y", "i", "depth")
    return cluster.add_back(members, loose, 0.05).select("frame_id", "i", "root")


_COMPONENTS = """
, reach(frame_id, i, root) AS (SELECT frame_id, i, i FROM patch WHERE body
    UNION SELECT r.frame_id, p.i, r.root FROM reach r JOIN patch q ON q.frame_id = r.frame_id AND q.i = r.i JOIN patch p ON p.frame_id = r.frame_id AND p.body AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.i > r.root),
comp AS (SELECT p.frame_id, p.i, p.x, p.y, p.depth, min(root) AS root FROM reach JOIN patch p USING (frame_id, i) GROUP BY ALL)
"""
# A component's smallest pixel reaches all of it over larger pixels only, so the restriction above loses nothing.
_BOX = ", box AS (SELECT frame_id, root, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM comp GROUP BY frame_id, root)"
_CENTRE = ", cen AS (SELECT frame_id, root, sum(depth) AS confidence, CAST(round(avg(x)) AS INT) AS cx, CAST(round(avg(y)) AS INT) AS cy FROM comp GROUP BY frame_id, root)"


def _with(sql: str) -> str:
    return with_views(sql, "patch", recursive=True)


ORACLES = {
    "scanline_runs": with_views(" SELECT frame_id, y, min(x) AS \"left\", max(x) AS \"right\" FROM (SELECT frame_id, x, y, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) AS g FROM patch WHERE body) r GROUP BY frame_id, y, g", "patch"),
    "touching_runs": with_views(", r AS (SELECT frame_id, y, min(x) AS l, max(x) AS r FROM (SELECT frame_id, x, y, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) AS g FROM patch WHERE body) k GROUP BY frame_id, y, g) SELECT a.frame_id, a.y, a.l AS \"left\", a.r AS \"right\", b.l AS b_left, b.r AS b_right FROM r a JOIN r b ON a.frame_id = b.frame_id AND b.y = a.y + 1 AND a.l <= b.r AND a.r >= b.l", "patch"),
    "connected_components": _with(_COMPONENTS + " SELECT frame_id, i, root FROM comp"),
    "component_centroid": _with(_COMPONENTS + _CENTRE + " SELECT frame_id, root, round(confidence, 6) AS confidence, cx, cy FROM cen"),
    "nearest_member": _with(_COMPONENTS + _CENTRE + " SELECT frame_id, root, i FROM (SELECT c.frame_id, c.root, c.i, row_number() OVER (PARTITION BY c.frame_id, c.root ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), c.i) AS k FROM comp c JOIN cen USING (frame_id, root)) q WHERE k = 1"),
    "component_confidence": _with(_COMPONENTS + _CENTRE + " SELECT frame_id, root, round(confidence, 6) AS confidence, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY round(confidence, 6) DESC, root) AS INT) AS place FROM cen"),
    "flood_fill": _with(", f(frame_id, i) AS (SELECT frame_id, i FROM patch WHERE i = 11 UNION SELECT f.frame_id, b.i FROM f JOIN patch a ON a.frame_id = f.frame_id AND a.i = f.i JOIN patch b ON b.frame_id = f.frame_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.depth - a.depth < 8e-2 AND b.y >= 1) SELECT frame_id, i FROM f"),
    "cluster_bbox_filter": _with(_COMPONENTS + _BOX + " SELECT * FROM box WHERE max_x - min_x + 1 BETWEEN 2 AND 5 AND max_y - min_y + 1 BETWEEN 2 AND 5"),
    "tiny_merge": _with(_COMPONENTS + ", s AS (SELECT *, count(*) OVER (PARTITION BY frame_id, root) AS n FROM comp), t AS (SELECT a.frame_id, a.root, min(b.root) AS big FROM s a JOIN s b ON a.frame_id = b.frame_id AND b.n >= 3 AND (b.i = a.i - 1 OR b.i = a.i - 8) WHERE a.n < 2 AND a.x > 0 AND a.y > 0 GROUP BY 1, 2) SELECT s.frame_id, s.i, coalesce(t.big, s.root) AS root FROM s LEFT JOIN t USING (frame_id, root)"),
    "bbox_overlap_merge": _with(_COMPONENTS + _BOX + " SELECT a.frame_id, a.root AS a_root, b.root AS b_root FROM box a JOIN box b ON a.frame_id = b.frame_id AND a.root < b.root AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y"),
    "add_back_edges": _with(_COMPONENTS + " SELECT frame_id, i, root FROM comp UNION ALL SELECT p.frame_id, p.i, min(c.root) FROM patch p JOIN comp c ON c.frame_id = p.frame_id AND abs(p.x - c.x) + abs(p.y - c.y) = 1 AND abs(p.depth - c.depth) < 5e-2 WHERE NOT p.body GROUP BY 1, 2"),
}

QUERIES = {f.__name__: f for f in (scanline_runs, touching_runs, connected_components, component_centroid, nearest_member, component_confidence, flood_fill, cluster_bbox_filter, tiny_merge, bbox_overlap_merge, add_back_edges)}
