"""Proportional stratified interleaving into shards, as DataFrame operations only.

Rows of a source are ordered by a seeded hash and get fractional ranks (2r+1)/(2n); sorted by those, the sources are
mixed alike all along, and even cuts give shards whose sizes differ by one row at most. Both ranks come from counts
of small ordered buckets (about the square root of all rows each), so neither a hot source nor the global order ever
meets in one task.

A null or empty text has size 1 and checksum 0; null sources are one source of their own; rows without an id and
repeated rows are dealt like others (equal rows are interchangeable). Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from math import ceil, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SEED = 17


def _rank(rows: DataFrame, within: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """0-based rank by (bucket, order) within ``within``; ``order`` must refine the order of ``bucket``."""
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(*within, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    bases = counts.select(*within, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    place = F.row_number().over(Window.partitionBy(*within, "bucket").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(bases, [*within, "bucket"]).withColumn(name, F.col("place") + F.col("base")).drop("bucket", "place", "base")


def interleave(docs: DataFrame, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not by key)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("source"))
    rows = settle(rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))), "dealt")
    sizes = rows.groupBy("source").agg(F.count("*").alias("of_source"))
    total = rows.count()
    buckets = max(1, ceil(sqrt(total)))
    digits = max(1, ceil(log(buckets, 16)))
    ranked = _rank(rows, ["source"], F.substring("key", 1, digits), ["key", "doc_id", "text_crc32", "size"], "r").join(sizes, "source")
    ranked = ranked.withColumn("fraction", (2 * F.col("r") + 1).cast("double") / (2 * F.col("of_source")).cast("double"))
    placed = _rank(ranked, [], F.floor(F.col("fraction") * F.lit(float(buckets))), ["fraction", "source"], "position")
    shard = F.expr(f"position * {shards} div {max(1, total)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("position") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
