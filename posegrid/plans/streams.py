"""Structured Streaming queries, the batch queries they must equal, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import ship
from ..sources.adapters import stream, with_views
from ..streaming import codebook, people, run


def _rounded(df, column):
    return df.withColumn(column, F.round(column, 6))


def codebook_fold(spark, sf_dir):
    ship(spark)
    return _rounded(codebook.batch_codebook(stream(spark, sf_dir)), "mean")


def people_fold(spark, sf_dir):
    ship(spark)
    return _rounded(people.batch_people(stream(spark, sf_dir)), "position")


def stream_codebook(spark, sf_dir):
    rows = run.drained(codebook.stream_codebook(run.event_frames(spark, f"{sf_dir}/events.parquet")))
    return _rounded(run.newest(rows, ["key"]), "mean").select("key", "word", "mean", "n", "created", "seen", "runs", "frames")


def stream_people(spark, sf_dir):
    rows = run.drained(people.stream_people(run.event_frames(spark, f"{sf_dir}/events.parquet")))
    return _rounded(run.newest(rows, ["key"]), "position").select("key", "person", "position", "first_us", "last_us", "n")


def stream_latest(spark, sf_dir):
    rows = run.drained(run.latest_frames(run.event_frames(spark, f"{sf_dir}/events.parquet")))
    return run.newest(rows, ["key"]).select("key", "event_id", "us", F.round("depth", 6).alias("depth"))


def stream_windows(spark, sf_dir):
    rows = run.drained(run.windowed_rates(run.event_frames(spark, f"{sf_dir}/events.parquet")))
    return run.newest(rows, ["start_us", "kind"]).select("start_us", "kind", "n", F.round("mean_depth", 6).alias("mean_depth"))


ORACLES = {
    "stream_latest": with_views(" SELECT key, event_id, us, round(depth, 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us DESC, event_id DESC) AS k FROM stream) x WHERE k = 1", "stream"),
    "stream_windows": with_views(" SELECT us - us % 86400000000 AS start_us, kind, count(*) AS n, round(avg(depth), 6) AS mean_depth FROM stream GROUP BY 1, 2", "stream"),
}

QUERIES = {f.__name__: f for f in (codebook_fold, people_fold, stream_codebook, stream_people, stream_latest, stream_windows)}
