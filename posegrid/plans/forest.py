"""Queries of features, training, inference and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, forest
from ..session import settle
from ..sources.adapters import images, literal_table, pixels, table, with_views

#: Candidates and thresholds of the queries.
UV = [((7 * c) % 64, (13 * c + 5) % 64) for c in range(100)]
CUTS = [t * 0.02 for t in range(-12, 13)]
SMALL_UV = UV[:12]
SMALL_CUTS = [t * 0.04 for t in range(-3, 4)]
OFFSETS = [(2.0, 0.0, -2.0, 0.0), (0.0, 4.0, 3.0, -3.0), (-5.0, 2.0, 1.0, 1.0)]
#: A literal forest: tree, node, c, t; leaves have no split.
TREES = [(0, 0, 1, 3), (0, 1, 2, 2), (0, 2, 5, 4), (1, 0, 7, 3), (1, 2, 3, 3)]
DEPTH = 3
LABEL_MAP = [(k, k // 3) for k in range(10)]


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def label_histogram(spark, sf_dir):
    return forest.label_histogram(_samples(spark, sf_dir))


def body_bounds(spark, sf_dir):
    return forest.body_bounds(pixels(spark, sf_dir))


def sample_pixels(spark, sf_dir):
    return forest.sample_pixels(pixels(spark, sf_dir), 8, 3)


def _gradients(spark, sf_dir, mirror):
    x, y = F.col("x"), F.col("y")
    spots = images(spark, sf_dir).select("frame_id", "depth", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).withColumns({"x": F.col("i") % 8, "y": F.expr("cast(i div 8 as int)")})
    return spots.select("frame_id", "x", "y", *[F.round(forest.uv_gradient(F.col("depth"), x, y, uv, mirror), 6).alias(f"g{k}") for k, uv in enumerate(OFFSETS)])


def uv_gradient(spark, sf_dir):
    return _gradients(spark, sf_dir, False)


def mirror_gradient(spark, sf_dir):
    return _gradients(spark, sf_dir, True)


def mirror_image(spark, sf_dir):
    return images(spark, sf_dir).select("frame_id", F.posexplode(forest.mirrored(F.col("depth"))).alias("i", "depth")).select("frame_id", "i", F.round("depth", 6).alias("depth"))


def uvt_histogram(spark, sf_dir):
    return forest.uvt_histograms(_samples(spark, sf_dir).withColumn("node", F.lit(0)), SMALL_UV, SMALL_CUTS)


def split_gain_topk(spark, sf_dir):
    gains = forest.split_gains(forest.uvt_histograms(_samples(spark, sf_dir).withColumn("node", F.lit(0)), UV, CUTS))
    return gains.select("c", "t", "n_left", "n_right", F.round("gain", 6).alias("gain")).orderBy(F.desc("gain"), "c", "t").limit(20)


def _split(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("node", F.lit(0).cast("long"))
    best = forest.best_splits(forest.split_gains(forest.uvt_histograms(rows, SMALL_UV, SMALL_CUTS)))
    return rows, best


def split_route(spark, sf_dir):
    rows, best = _split(spark, sf_dir)
    return forest.route(rows, best, SMALL_UV, SMALL_CUTS).groupBy("node", "label").agg(F.count("*").alias("n"))


def train_tree_d3(spark, sf_dir):
    nodes = forest.train_tree(_samples(spark, sf_dir), SMALL_UV, SMALL_CUTS, DEPTH, settle)
    return nodes.select("node", "c", "t", "n", "is_leaf", F.explode("pr").alias("label", "p")).select("node", "c", "t", "n", "is_leaf", "label", F.round("p", 6).alias("p"))


def _trees(spark):
    return literal_table(spark, TREES, "tree int, node long, c int, t int")


def tree_walk(spark, sf_dir):
    return forest.walk(_samples(spark, sf_dir), _trees(spark), SMALL_UV, SMALL_CUTS, DEPTH).select("vec_id", "tree", "node")


def _leaf_pr(spark, sf_dir):
    """The label distribution of a leaf, by counting the samples that reach it."""
    leaves = forest.walk(_samples(spark, sf_dir), _trees(spark), SMALL_UV, SMALL_CUTS, DEPTH)
    counts = leaves.groupBy("tree", "node", "label").agg(F.count("*").alias("n"))
    labels = [F.coalesce(F.max(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) / F.sum("n") for k in range(10)]
    return leaves, counts.groupBy("tree", "node").agg(F.array(*labels).alias("pr"))


def forest_mean(spark, sf_dir):
    leaves, pr = _leaf_pr(spark, sf_dir)
    mean = evaluate.mean_leaves(leaves.join(F.broadcast(pr), ["tree", "node"]), ["vec_id"])
    return mean.select("vec_id", F.posexplode("pr").alias("label", "p")).select("vec_id", "label", F.round("p", 6).alias("p"))


def argmax_label(spark, sf_dir):
    leaves, pr = _leaf_pr(spark, sf_dir)
    return leaves.join(F.broadcast(pr), ["tree", "node"]).select("vec_id", "tree", "label", evaluate.argmax_label(F.col("pr")).alias("pred"))


def _pixel_truth(spark, sf_dir):
    """Truth and prediction by pixel from depth bands, a stand-in for inferred label images."""
    v = F.col("value")
    band = lambda x: F.when(x < -0.05, 0).when(x < 0.05, 1).when(x < 0.1, 2).otherwise(3)
    return pixels(spark, sf_dir).select("frame_id", "i", band(v).alias("truth"), band(v + (F.col("i") % 5 - 2) * 0.02).alias("pred"))


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_pixel_truth(spark, sf_dir))


def image_accuracy(spark, sf_dir):
    return evaluate.image_accuracy(_pixel_truth(spark, sf_dir)).select("frame_id", F.round("accuracy", 6).alias("accuracy"), "n_labels")


def _accuracy(spark, sf_dir):
    return evaluate.image_accuracy(_pixel_truth(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def accuracy_summary(spark, sf_dir):
    return evaluate.accuracy_summary(_accuracy(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("average", "median", "worst", "best")])


def accuracy_hist50(spark, sf_dir):
    return evaluate.accuracy_histogram(_accuracy(spark, sf_dir))


def low_accuracy_index(spark, sf_dir):
    return evaluate.low_accuracy(_accuracy(spark, sf_dir), 0.5).select("frame_id")


def evaluation_report(spark, sf_dir):
    rows = _pixel_truth(spark, sf_dir)
    summary = evaluate.accuracy_summary(_accuracy(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("average", "median", "worst", "best")])
    return evaluate.evaluation_json(summary, evaluate.confusion(rows))


def label_remap(spark, sf_dir):
    m = literal_table(spark, LABEL_MAP, "input int, label int")
    return evaluate.remap(_samples(spark, sf_dir), m).groupBy("label").agg(F.count("*").alias("n"))


def prob_remap(spark, sf_dir):
    m = literal_table(spark, LABEL_MAP, "input int, label int")
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 10).cast("int").alias("label")).agg(F.count("*").alias("n"))
    whole = p.groupBy("k").agg(F.sum("n").alias("s"))
    rows = p.join(whole, "k").select("k", "label", (F.col("n") / F.col("s")).alias("p"))
    return evaluate.remap_probabilities(rows, m, ["k"]).select("k", "label", F.round("p", 6).alias("p"))


def validate_label_map(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.expr("cast(p_partkey * 7 % 300 as int)").alias("input"), "p_brand")
    return evaluate.label_map_faults(m)


def rank_results(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.round(F.max("l_discount"), 4).alias("best_discount"), F.count("*").cast("double").alias("n_lines"))
    return evaluate.rank_results(rows, ["mean_quantity", "best_discount", "n_lines"], 5, ["l_suppkey"])


def tree_stats(spark, sf_dir):
    nodes = forest.train_tree(_samples(spark, sf_dir), SMALL_UV, SMALL_CUTS, DEPTH, settle)
    return forest.tree_stats(nodes)


_GRADIENTS = """
, d AS (SELECT frame_id, x, y, i, depth FROM patch), img AS (SELECT frame_id, list(depth ORDER BY i) AS img FROM patch GROUP BY frame_id)
SELECT d.frame_id, d.x, d.y, {columns} FROM d JOIN img USING (frame_id)"""


def _gradient_sql(sign: float) -> str:
    def read(a: float, b: float) -> str:
        x, y = f"CAST(trunc(x + {sign * a!r}e0 / depth) AS INT)", f"CAST(trunc(y + {b!r}e0 / depth) AS INT)"
        return f"(CASE WHEN {x} BETWEEN 0 AND 7 AND {y} BETWEEN 0 AND 7 THEN img[{y} * 8 + {x} + 1] ELSE 32e0 END)"

    return with_views(_GRADIENTS.format(columns=", ".join(f"round({read(u[0], u[1])} - {read(u[2], u[3])}, 6) AS g{k}" for k, u in enumerate(OFFSETS))), "patch")


def _pairs_sql(uv) -> str:
    return "uv AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {a}, {b})" for c, (a, b) in enumerate(uv)) + ") v(c, a, b))"


def _cuts_sql(cuts) -> str:
    return "cuts AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x!r}e0)" for k, x in enumerate(cuts)) + ") v(t, cut))"


def _hist_sql(rows: str, name: str) -> str:
    """Histograms of ``rows`` (node, label, embedding)."""
    return f"""{name} AS (SELECT node, c, t, label, CAST(sum(CASE WHEN g < cut THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN g < cut THEN 0 ELSE 1 END) AS BIGINT) AS n_right
        FROM (SELECT node, label, c, CAST(embedding[a + 1] AS DOUBLE) - CAST(embedding[b + 1] AS DOUBLE) AS g FROM {rows}, uv) x, cuts GROUP BY node, c, t, label)"""


def _gain_sql(hist: str, name: str) -> str:
    h = lambda n, s: f"sum(CASE WHEN ({n}) > 0 AND ({n}) < {s} THEN -(({n}) * 1e0 / {s}) * log2(({n}) * 1e0 / {s}) ELSE 0e0 END)"
    return f"""{name} AS (SELECT node, c, t, max(l) AS n_left, max(r) AS n_right,
        {h('n_left + n_right', '(l + r)')} - max(l) * 1e0 / (max(l) + max(r)) * {h('n_left', 'l')} - max(r) * 1e0 / (max(l) + max(r)) * {h('n_right', 'r')} AS gain
        FROM (SELECT *, CAST(sum(n_left) OVER w AS BIGINT) AS l, CAST(sum(n_right) OVER w AS BIGINT) AS r FROM {hist} WINDOW w AS (PARTITION BY node, c, t)) x GROUP BY node, c, t)"""


def _best_sql(gain: str, name: str) -> str:
    return f"{name} AS (SELECT node, c, t, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, c, t) AS k FROM {gain}) x WHERE k = 1)"


def _route_sql(rows: str, best: str, name: str) -> str:
    return f"""{name} AS (SELECT label, embedding, CASE WHEN CAST(embedding[a + 1] AS DOUBLE) - CAST(embedding[b + 1] AS DOUBLE) < cut THEN 2 * s.node + 1 ELSE 2 * s.node + 2 END AS node
        FROM {rows} s JOIN {best} USING (node) JOIN uv USING (c) JOIN cuts USING (t))"""


_ROOT = "s0 AS (SELECT CAST(0 AS BIGINT) AS node, label, embedding FROM embeddings)"
_SPLIT = f"WITH {_ROOT}, {_pairs_sql(SMALL_UV)}, {_cuts_sql(SMALL_CUTS)}, {_hist_sql('s0', 'h0')}"
_GROWN = f"""{_SPLIT}, {_gain_sql('h0', 'g0')}, {_best_sql('g0', 'r0')}, b0 AS (SELECT * FROM r0 WHERE round(gain, 9) > 0), {_route_sql('s0', 'b0', 's1')},
{_hist_sql('s1', 'h1')}, {_gain_sql('h1', 'g1')}, {_best_sql('g1', 'r1')}, b1 AS (SELECT * FROM r1 WHERE round(gain, 9) > 0), {_route_sql('s1', 'b1', 's2')},
rows AS (SELECT node, label FROM s0 UNION ALL SELECT node, label FROM s1 UNION ALL SELECT node, label FROM s2),
best AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1),
counts AS (SELECT node, label, count(*) AS k FROM rows GROUP BY node, label)"""


def _walk_sql() -> str:
    value = f"WITH RECURSIVE {_pairs_sql(SMALL_UV)}, {_cuts_sql(SMALL_CUTS)}, trees AS (SELECT * FROM (VALUES " + ", ".join(map(str, TREES)) + ") v(tree, node, c, t)), start AS (SELECT vec_id, label, embedding, tree, CAST(0 AS BIGINT) AS node0 FROM embeddings, (SELECT DISTINCT tree FROM trees) k)"
    for level in range(DEPTH):
        last = "start" if not level else f"w{level}"
        value += f""", w{level + 1} AS (SELECT s.vec_id, s.label, s.embedding, s.tree, CASE WHEN k.c IS NULL THEN s.node{level} WHEN CAST(embedding[a + 1] AS DOUBLE) - CAST(embedding[b + 1] AS DOUBLE) < cut THEN 2 * s.node{level} + 1 ELSE 2 * s.node{level} + 2 END AS node{level + 1}
            FROM {last} s LEFT JOIN trees k ON k.tree = s.tree AND k.node = s.node{level} LEFT JOIN uv ON uv.c = k.c LEFT JOIN cuts ON cuts.t = k.t)"""
    return value


_LEAF_PR = f""", leaves AS (SELECT vec_id, label, tree, node{DEPTH} AS node FROM w{DEPTH}), n AS (SELECT tree, node, label, count(*) AS k FROM leaves GROUP BY tree, node, label),
pr AS (SELECT DISTINCT l.tree, l.node, CAST(r.k AS INT) AS label, coalesce(n.k, 0) * 1e0 / s.s AS p FROM leaves l JOIN (SELECT tree, node, count(*) AS s FROM leaves GROUP BY tree, node) s USING (tree, node) CROSS JOIN range(10) r(k) LEFT JOIN n ON n.tree = l.tree AND n.node = l.node AND n.label = r.k)"""

_BAND = "CASE WHEN {0} < -5e-2 THEN 0 WHEN {0} < 5e-2 THEN 1 WHEN {0} < 1e-1 THEN 2 ELSE 3 END"
_TRUTH = f"""
, px AS (SELECT frame_id, i, {_BAND.format('value')} AS truth, {_BAND.format('(value + (i % 5 - 2) * 2e-2)')} AS pred FROM patch),
acc0 AS (SELECT frame_id, avg(r) AS accuracy, count(*) AS n_labels FROM (SELECT frame_id, truth, avg(CASE WHEN truth = pred THEN 1e0 ELSE 0e0 END) AS r FROM px GROUP BY frame_id, truth) x GROUP BY frame_id),
acc AS (SELECT frame_id, round(accuracy, 9) AS accuracy, n_labels FROM acc0)
"""
_MAP = "WITH m AS (SELECT * FROM (VALUES " + ", ".join(map(str, LABEL_MAP)) + ") v(input, mapped))"

ORACLES = {
    "label_histogram": "SELECT label, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (), 9) AS share FROM embeddings GROUP BY label",
    "body_bounds": with_views(" SELECT frame_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n_body FROM patch WHERE body GROUP BY frame_id", "patch"),
    "sample_pixels": with_views(", b AS (SELECT frame_id, list(i ORDER BY i) AS spots FROM patch WHERE body GROUP BY frame_id) SELECT frame_id, CAST(k AS INT) AS draw, spots[((frame_id * 7919 + k * 104729 + 3) % 1000003) % len(spots) + 1] AS i FROM b, range(8) r(k)", "patch"),
    "uv_gradient": _gradient_sql(1.0),
    "mirror_gradient": _gradient_sql(-1.0),
    "mirror_image": with_views(" SELECT frame_id, CAST(y * 8 + 7 - x AS INT) AS i, round(depth, 6) AS depth FROM patch", "patch"),
    "uvt_histogram": _SPLIT + " SELECT * FROM h0",
    "split_gain_topk": f"WITH {_ROOT}, {_pairs_sql(UV)}, {_cuts_sql(CUTS)}, {_hist_sql('s0', 'h0')}, {_gain_sql('h0', 'g0')} SELECT c, t, n_left, n_right, round(gain, 6) AS gain FROM g0 ORDER BY round(gain, 6) DESC, c, t LIMIT 20",
    "split_route": f"{_SPLIT}, {_gain_sql('h0', 'g0')}, {_best_sql('g0', 'b0')}, {_route_sql('s0', 'b0', 's1')} SELECT node, label, count(*) AS n FROM s1 GROUP BY node, label",
    "train_tree_d3": _GROWN + " SELECT k.node, b.c, b.t, CAST(sum(k.k) OVER (PARTITION BY k.node) AS BIGINT) AS n, b.c IS NULL AS is_leaf, k.label, round(k.k * 1e0 / sum(k.k) OVER (PARTITION BY k.node), 6) AS p FROM counts k LEFT JOIN best b ON b.node = k.node",
    "tree_walk": _walk_sql() + f" SELECT vec_id, tree, node{DEPTH} AS node FROM w{DEPTH}",
    "forest_mean": _walk_sql() + _LEAF_PR + " SELECT vec_id, pr.label, round(avg(p), 6) AS p FROM leaves JOIN pr USING (tree, node) GROUP BY vec_id, pr.label",
    "argmax_label": _walk_sql() + _LEAF_PR + ", top AS (SELECT tree, node, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY p DESC, label) AS k FROM pr) x WHERE k = 1) SELECT vec_id, tree, label, pred FROM leaves JOIN top USING (tree, node)",
    "confusion_matrix": with_views(_TRUTH + " SELECT truth, pred, count(*) AS n FROM px GROUP BY truth, pred", "patch"),
    "image_accuracy": with_views(_TRUTH + " SELECT frame_id, round(accuracy, 6) AS accuracy, n_labels FROM acc0", "patch"),
    "accuracy_summary": with_views(_TRUTH + " SELECT round(avg(accuracy), 6) AS average, round((SELECT accuracy FROM (SELECT accuracy, row_number() OVER (ORDER BY accuracy, frame_id) - 1 AS k, count(*) OVER () AS n FROM acc) x WHERE k = n // 2), 6) AS median, round(min(accuracy), 6) AS worst, round(max(accuracy), 6) AS best FROM acc", "patch"),
    "accuracy_hist50": with_views(_TRUTH + " SELECT CAST(least(floor(accuracy * 50), 49) AS INT) AS bucket, count(*) AS n FROM acc GROUP BY 1", "patch"),
    "low_accuracy_index": with_views(_TRUTH + " SELECT frame_id FROM acc WHERE accuracy < 5e-1", "patch"),
    "label_remap": _MAP + " SELECT mapped AS label, count(*) AS n FROM embeddings e JOIN m ON m.input = e.label GROUP BY mapped",
    "prob_remap": _MAP + ", p AS (SELECT c_nationkey AS k, c_custkey % 10 AS label, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY c_nationkey) AS p FROM customer GROUP BY 1, 2) SELECT k, mapped AS label, round(sum(p), 6) AS p FROM p JOIN m ON m.input = p.label GROUP BY k, mapped",
    "validate_label_map": "SELECT CAST(p_partkey * 7 % 300 AS INT) AS input, count(*) AS n_uses, (p_partkey * 7 % 300 < 0 OR p_partkey * 7 % 300 > 255) AS out_of_range FROM part GROUP BY 1, 3 HAVING count(*) > 1 OR out_of_range",
    "rank_results": """WITH r AS (SELECT l_suppkey, round(avg(l_quantity), 4) AS mean_quantity, round(max(l_discount), 4) AS best_discount, CAST(count(*) AS DOUBLE) AS n_lines FROM lineitem GROUP BY 1),
        l AS (SELECT l_suppkey, 'mean_quantity' AS metric, mean_quantity AS score FROM r UNION ALL SELECT l_suppkey, 'best_discount', best_discount FROM r UNION ALL SELECT l_suppkey, 'n_lines', n_lines FROM r)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY score DESC, l_suppkey) AS INT) AS place FROM l) x WHERE place <= 5""",
    "tree_stats": _GROWN + " , nodes AS (SELECT DISTINCT k.node, b.c IS NULL AS is_leaf FROM counts k LEFT JOIN best b ON b.node = k.node) SELECT CAST(floor(log2(node + 1)) AS INT) AS depth, count(*) AS n_nodes, CAST(sum(CASE WHEN is_leaf THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, round(count(*) * 1e2 / pow(2e0, floor(log2(node + 1))), 6) AS filled FROM nodes GROUP BY floor(log2(node + 1))",
}

QUERIES = {f.__name__: f for f in (label_histogram, body_bounds, sample_pixels, uv_gradient, mirror_gradient, mirror_image, uvt_histogram, split_gain_topk, split_route, train_tree_d3, tree_walk, forest_mean, argmax_label, confusion_matrix, image_accuracy, accuracy_summary, accuracy_hist50, low_accuracy_index, evaluation_report, label_remap, prob_remap, validate_label_map, rank_results, tree_stats)}
