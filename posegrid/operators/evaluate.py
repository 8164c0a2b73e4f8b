"""Inference evaluation: label remaps, argmax, confusion, per-image accuracy and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax_label(pr: Column) -> Column:
    """Position of the first largest probability."""
    return (F.array_position(pr, F.array_max(pr)) - 1).cast("int")


def mean_leaves(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the label distributions (column pr, array) that the trees of a forest reached."""
    of_trees = leaves.groupBy(*keys).agg(F.collect_list("pr").alias("prs"))  # an array a tree
    sums = lambda i: F.aggregate("prs", F.lit(0.0), lambda total, pr: total + F.get(pr, i))
    return of_trees.select(*keys, F.transform(F.get("prs", F.lit(0)), lambda _, i: sums(i) / F.size("prs")).alias("pr"))


def remap(rows: DataFrame, label_map: DataFrame, column: str = "label") -> DataFrame:
    """Replace labels by a many-to-one map (input, label)."""
    m = F.broadcast(label_map.select(F.col("input").alias(column), F.col("label").alias("_to")))
    return rows.join(m, column).withColumn(column, F.col("_to")).drop("_to")


def remap_probabilities(rows: DataFrame, label_map: DataFrame, keys: list[str]) -> DataFrame:
    """Sum probabilities (rows of label, p) that map to the same label."""
    m = F.broadcast(label_map.select(F.col("input").alias("label"), F.col("label").alias("mapped")))
    return rows.join(m, "label").groupBy(*keys, F.col("mapped").alias("label")).agg(F.sum("p").alias("p"))


def label_map_faults(label_map: DataFrame, most: int = 255) -> DataFrame:
    """Inputs that are used more than once or out of range."""
    by = label_map.groupBy("input").agg(F.count("*").alias("n_uses"))
    return by.select("input", "n_uses", ((F.col("input") < 0) | (F.col("input") > most)).alias("out_of_range")).where("n_uses > 1 or out_of_range")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def image_accuracy(rows: DataFrame) -> DataFrame:
    """Mean over the labels present in an image of the share of their pixels that were found."""
    by = rows.groupBy("frame_id", "truth").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("recall"))
    return by.groupBy("frame_id").agg(F.avg("recall").alias("accuracy"), F.count("*").alias("n_labels"))


def accuracy_summary(images: DataFrame) -> DataFrame:
    """average, median (the upper one), worst, best. The median is the value at rank n div 2 of the exact order.

    Images are counted by value first, so that equal accuracies are one row; ranks then come from counts by bucket.
    """
    values = images.groupBy("accuracy").agg(F.count("*").alias("k")).withColumn("b", F.floor(F.col("accuracy") * 1000))
    upto = F.sum("k").over(Window.orderBy("b"))  # at most 1001 buckets
    buckets = values.groupBy("b").agg(F.sum("k").alias("k")).select("b", (upto - F.col("k")).alias("base"), F.sum("k").over(Window.partitionBy()).alias("n"))
    ranked = values.withColumn("upto", F.sum("k").over(Window.partitionBy("b").orderBy("accuracy"))).join(F.broadcast(buckets), "b")
    first = F.col("base") + F.col("upto") - F.col("k")
    median = ranked.where((first <= F.expr("n div 2")) & (F.expr("n div 2") < first + F.col("k"))).select(F.col("accuracy").alias("median"))
    whole = values.agg((F.sum(F.col("accuracy") * F.col("k")) / F.sum("k")).alias("average"), F.min("accuracy").alias("worst"), F.max("accuracy").alias("best"))
    return whole.crossJoin(F.broadcast(median)).select("average", "median", "worst", "best")


def accuracy_histogram(images: DataFrame, buckets: int = 50) -> DataFrame:
    return images.groupBy(F.least(F.floor(F.col("accuracy") * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def low_accuracy(images: DataFrame, least: float) -> DataFrame:
    return images.where(F.col("accuracy") < least)


def rank_results(rows: DataFrame, metrics: list[str], top: int, keys: list[str]) -> DataFrame:
    """The best ``top`` runs for each metric."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])).alias("m")).select(*keys, "m.*")
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"), *keys))
    return long.withColumn("place", place).where(F.col("place") <= top)


def close_to(x: Column, value: float, tolerance: float = 1e-6) -> Column:
    return F.abs(x - value) <= tolerance


def evaluation_json(summary: DataFrame, matrix: DataFrame) -> DataFrame:
    """One JSON document of summary and confusion matrix (labels squared rows)."""
    cells = matrix.agg(F.array_sort(F.collect_list(F.struct("truth", "pred", "n"))).alias("confusion_matrix"))
    return summary.crossJoin(cells).select(F.to_json(F.struct(F.struct("average", "median", "worst", "best").alias("accuracy"), F.struct("confusion_matrix").alias("results"))).alias("json"))
