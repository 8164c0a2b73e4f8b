"""Views of the driver's tables as depth frames, frame streams and skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, BASE_DEPTH, BODY, FAR, N_JOINTS = 8, 2.0, 0.1, 32.0, 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame: frame_id, label, depth (row-major array of SIDE * SIDE metres)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame_id"), "label", F.transform("embedding", lambda v: v.cast("double") + BASE_DEPTH).alias("depth"))


def pixels(spark: SparkSession, sf_dir: str, image: bool = False) -> DataFrame:
    """One row a pixel: frame_id, label, i, x, y, value, depth, body; with ``image``, its whole frame beside it."""
    e = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda v: F.named_struct(F.lit("depth"), v.cast("double") + BASE_DEPTH, F.lit("body"), v.cast("double") > BODY))
    e = e.select(F.col("vec_id").alias("frame_id"), "label", F.posexplode("embedding").alias("i", "raw"), *[whole.alias("image")] * image)
    value = F.col("raw").cast("double")
    return e.select("frame_id", "label", "i", (F.col("i") % SIDE).alias("x"), F.expr(f"cast(i div {SIDE} as int)").alias("y"), value.alias("value"), (value + BASE_DEPTH).alias("depth"), (value > BODY).alias("body"), *["image"] * image)


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a stream: key, event_id, ts, us (microseconds), kind, depth."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("kind"), (F.col("value") / 100).alias("depth"), "value")


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeleton joints: frame_id, label, joint, valid, x, y, z."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(N_JOINTS - 1))).alias("joint"))
    at = lambda k: F.get("embedding", F.col("joint") * 3 + k).cast("double")
    return e.select(F.col("vec_id").alias("frame_id"), "label", "joint", (at(0) > -0.3).alias("valid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def struct_max(order: list[Column], value: str) -> Column:
    """Value of the row that is first by ``order`` descending."""
    return F.max_by(value, F.struct(*order))


#: The same views for DuckDB.
SQL = {
    "patch": """patch AS (SELECT vec_id AS frame_id, label, CAST(k AS INT) AS i, CAST(k % 8 AS INT) AS x, CAST(k // 8 AS INT) AS y,
        CAST(embedding[k + 1] AS DOUBLE) AS value, CAST(embedding[k + 1] AS DOUBLE) + 2e0 AS depth, CAST(embedding[k + 1] AS DOUBLE) > 1e-1 AS body
        FROM embeddings, range(64) r(k))""",
    "stream": "stream AS (SELECT user_id AS key, event_id, ts, epoch_us(ts) AS us, event_type AS kind, value / 100 AS depth, value FROM events)",
    "joints": """joints AS (SELECT vec_id AS frame_id, label, CAST(k AS INT) AS joint, CAST(embedding[3*k+1] AS DOUBLE) > -3e-1 AS valid,
        CAST(embedding[3*k+1] AS DOUBLE) AS x, CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE) AS z FROM embeddings, range(14) r(k))""",
}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """``sql`` (WITH-less CTE list and SELECT) after the named views."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[v] for v in views) + sql
