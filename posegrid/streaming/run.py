"""Stream sources and sinks: files in, one folder a micro-batch out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship


def event_frames(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Frames of a growing folder of event files (or of one file): key, event_id, ts, us, kind, depth."""
    ship(spark)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    e = source.parquet(f"{path}*" if path.endswith(".parquet") else path)
    return e.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("kind"), (F.col("value") / 100).alias("depth"))


def drained(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream until its source is empty; rows of all micro-batches with the column ``batch``.

    Each micro-batch overwrites a folder of its own, so a batch that is run again leaves no doubles.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/rows/batch=-1")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch int").parquet(f"{root}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's newest micro-batch."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")


def latest_frames(frames: DataFrame) -> DataFrame:
    """The newest frame of each key (a mailbox that holds one)."""
    return frames.groupBy("key").agg(F.max_by(F.struct("event_id", "us", "depth"), F.struct("us", "event_id")).alias("f")).select("key", "f.*")


def windowed_rates(frames: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Frames and mean depth by kind and tumbling window, with a watermark for late frames."""
    by = frames.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind")
    return by.agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth")).select(F.unix_micros("w.start").alias("start_us"), "kind", "n", "mean_depth")


