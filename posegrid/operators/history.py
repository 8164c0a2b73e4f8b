"""Operators over ordered frames of a key: histories, runs, as-of pairs, sampling and codewords."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

ORDER = ("us", "event_id")


def _by_key() -> Window:
    return Window.partitionBy("key").orderBy(*ORDER)


def bounded_history(frames: DataFrame, n: int = 12) -> DataFrame:
    """The newest n frames of each key, newest first."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(*[F.desc(c) for c in ORDER]))
    return frames.withColumn("place", place).where(F.col("place") <= n)


def velocity_outliers(frames: DataFrame, n: int = 12, factor: float = 2.0, least: float = 1.5) -> DataFrame:
    """Speed against the previous frame, and whether it exceeds ``least`` and ``factor`` times the mean of the n before."""
    w = _by_key()
    dt = (F.col("us") - F.lag("us").over(w)) / 1e6
    moved = F.abs(F.col("depth") - F.lag("depth").over(w))
    rows = frames.withColumn("speed", F.when(dt > 0, moved / dt * 1000))
    mean = F.avg("speed").over(w.rowsBetween(-n, -1))
    return rows.withColumn("mean_speed", mean).withColumn("outlier", F.coalesce((F.col("speed") > least) & (F.col("speed") > factor * F.col("mean_speed")), F.lit(False)))


def steadied(frames: DataFrame, n: int = 12, factor: float = 2.0, least: float = 1.5) -> DataFrame:
    """Depth with velocity outliers replaced: the depth before, moved on by the last displacement that was none."""
    w = _by_key()
    rows = velocity_outliers(frames, n, factor, least).withColumns({"before": F.lag("depth").over(w), "moved": F.col("depth") - F.lag("depth").over(w)})
    last = F.last(F.when(~F.col("outlier"), F.col("moved")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("steady", F.when(F.col("outlier"), F.col("before") + F.coalesce(last, F.lit(0.0))).otherwise(F.col("depth")))


def last_valid(frames: DataFrame, valid: Column) -> DataFrame:
    """Depth, with invalid frames taking the last valid depth before them."""
    return frames.withColumn("filled", F.last(F.when(valid, F.col("depth")), ignorenulls=True).over(_by_key().rowsBetween(Window.unboundedPreceding, 0)))


def consecutive_runs(frames: DataFrame, matches: Column) -> DataFrame:
    """Runs of matching frames next to each other, by key: number and longest."""
    w = _by_key()
    rows = frames.withColumn("n", F.row_number().over(w)).where(matches)
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(w))
    runs = rows.groupBy("key", "island").agg(F.count("*").alias("len"))
    return runs.groupBy("key").agg(F.count("*").alias("n_runs"), F.max("len").alias("longest"), F.sum("len").alias("n_frames"))


def keep_top(frames: DataFrame, idle_us: int, most: int) -> DataFrame:
    """Keys seen within ``idle_us`` of the newest frame, the most confident ``most`` of them, oldest first."""
    by = frames.groupBy("key").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.round(F.sum("depth"), 6).alias("confidence"))
    newest = by.agg(F.max("last_us").alias("newest"))
    return by.crossJoin(F.broadcast(newest)).where(F.col("newest") - F.col("last_us") <= idle_us).drop("newest").orderBy(F.desc("confidence"), "key").limit(most).orderBy("first_us", F.desc("confidence"), "key")


def ordered_pass(frames: DataFrame, columns: list[str], keep: Callable) -> DataFrame:
    """Frames that ``keep(state, row)`` takes, in order within a key; it returns (taken, new state), from None on.

    One shuffle by key and one sort; frames then stream through in Arrow batches with the state of one key, so neither
    a key's length nor what is kept of it is held in memory.
    """
    ship(frames.sparkSession)
    rows = frames.select("key", *ORDER, *columns).repartition("key").sortWithinPartitions("key", *ORDER)

    def run(batches):
        last, state = None, None
        for batch in batches:
            taken = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last or state is None:
                    last, state = row[0], None
                yes, state = keep(state, row)
                taken.append(yes)
            yield batch.filter(pa.array(taken, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def capped_mean(frames: DataFrame, cap: int) -> DataFrame:
    """Running mean whose count stops at ``cap``, after each key's last frame.

    Once the count stands, each frame weighs cap / (cap + 1) of the one after it: the mean is a weighted sum by the
    frame's place, so it needs two windows over the key's sort and no fold.
    """
    w = Window.partitionBy("key")
    rows = frames.withColumn("k", F.row_number().over(w.orderBy(*ORDER))).withColumn("n", F.count("*").over(w))
    # The first cap + 1 frames weigh alike (1 / (cap + 1) after frame cap + 1); each later one decays those before it.
    first = F.least(F.col("n"), F.lit(cap + 1))
    share = F.when(F.col("k") <= first, 1.0 / first).otherwise(F.lit(1.0 / (cap + 1)))
    weight = share * F.pow(F.lit(cap / (cap + 1)), F.col("n") - F.greatest(F.col("k").cast("long"), first))
    return rows.groupBy("key").agg(F.count("*").alias("n_frames"), F.sum(F.col("depth") * weight).alias("mean"))


def time_step_sample(frames: DataFrame, step_us: int) -> DataFrame:
    """Frames at least ``step_us`` after the last one kept."""
    return ordered_pass(frames, [], lambda at, row: (True, row[1]) if at is None or row[1] - at >= step_us else (False, at))


def changed_frames(frames: DataFrame, least: float) -> DataFrame:
    """Frames that differ from the last kept one by a share of ``least`` or more; the first is kept."""
    return ordered_pass(frames, ["depth"], lambda at, row: (True, row[3]) if at is None or abs(row[3] - at) >= least * at else (False, at))


def bracketed(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """Each request (key, request_id, us) with the frames just before and after it, and the depth between them.

    Two running windows over the union of both tables, one in each direction of time, each a linear pass of its sort;
    at the ends the near frame is used.
    """
    tagged = frames.select("key", "us", F.lit(0).alias("is_request"), F.struct("us", "depth").alias("frame"), F.lit(None).cast("long").alias("request_id"))
    asked = requests.select("key", "us", F.lit(1).alias("is_request"), F.lit(None).cast(tagged.schema["frame"].dataType).alias("frame"), "request_id")
    both = tagged.unionByName(asked)
    so_far = lambda *order: Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("frame", ignorenulls=True).over(so_far("us", "is_request"))
    after = F.last("frame", ignorenulls=True).over(so_far(F.desc("us"), F.desc("is_request")))
    rows = both.withColumn("a", before).withColumn("b", after).where("is_request = 1")
    t = F.when(F.col("b.us") > F.col("a.us"), (F.col("us") - F.col("a.us")) / (F.col("b.us") - F.col("a.us"))).otherwise(0.0)
    depth = F.when(F.col("a").isNull(), F.col("b.depth")).when(F.col("b").isNull(), F.col("a.depth")).otherwise(F.col("a.depth") + (F.col("b.depth") - F.col("a.depth")) * t)
    return rows.select("key", "request_id", F.col("a.us").alias("before_us"), F.col("b.us").alias("after_us"), depth.alias("depth"))


def latest_of_kinds(frames: DataFrame, master: str, other: str) -> DataFrame:
    """Each frame of kind ``master`` with the latest of kind ``other`` at or before it."""
    w = _by_key().rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.where(F.col("kind").isin(master, other)).withColumn("other_id", F.last(F.when(F.col("kind") == other, F.col("event_id")), ignorenulls=True).over(w))
    return rows.where(F.col("kind") == master).select("key", "event_id", "other_id")


def stage_durations(frames: DataFrame, n: int = 30) -> DataFrame:
    """Average of all, and upper median of the last n, by stage."""
    newest = F.row_number().over(Window.partitionBy("kind").orderBy(*[F.desc(c) for c in ORDER]))
    last = frames.withColumn("age", newest).where(F.col("age") <= n)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("value", "event_id")) - 1
    count = F.count("*").over(Window.partitionBy("kind"))
    median = last.withColumn("place", place).withColumn("c", count).where(F.col("place") == F.expr("c div 2")).select("kind", F.col("value").alias("median"))
    return frames.groupBy("kind").agg(F.round(F.avg("value"), 6).alias("average"), F.count("*").alias("n")).join(F.broadcast(median), "kind").select("kind", "average", "median", "n")


def codewords(frames: DataFrame, width: float) -> DataFrame:
    """Depth bands of a key: mean, count, first and last time, and frames between."""
    rows = frames.withColumn("n_frame", F.row_number().over(_by_key()))
    return rows.groupBy("key", F.floor(F.col("depth") / width).alias("band")).agg(
        F.avg("depth").alias("mean"), F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("n_frame").alias("first_frame"), F.max("n_frame").alias("last_frame"))


def background_words(words: DataFrame) -> DataFrame:
    """The codeword seen most often, the farther one on ties, for each key."""
    return words.groupBy("key").agg(F.max_by(F.struct("band", "mean", "n"), F.struct("n", F.round("mean", 9), "band")).alias("b")).select("key", "b.*")


def classify(words: DataFrame, background: DataFrame, near: float, flat: float, often: int, share: float) -> DataFrame:
    """Class of each codeword against its key's background."""
    bg = background.select("key", F.col("mean").alias("bg_mean"), F.col("band").alias("bg_band"))
    away = F.abs(F.col("mean") - F.col("bg_mean"))
    frames = F.col("last_frame") - F.col("first_frame") + 1
    kind = F.when((F.col("band") == F.col("bg_band")) | (away <= near), "BACKGROUND").when(away <= flat, "FLAT").when((F.col("n") > often) & (F.col("n") / frames >= share), "IGNORED").otherwise("FOREGROUND")
    return words.join(bg, "key").select("key", "band", "n", F.round("mean", 6).alias("mean"), kind.alias("class"))


def nearest_codeword(frames: DataFrame, words: DataFrame, reach: float, width: float) -> DataFrame:
    """The codeword nearest to each frame within reach; only bands that can hold one are looked at."""
    k = int(reach / width) + 2
    near = frames.select("key", "event_id", "depth", F.explode(F.sequence(F.floor(F.col("depth") / width) - k, F.floor(F.col("depth") / width) + k)).alias("band"))
    away = F.abs(F.col("depth") - F.col("mean"))
    found = near.join(words.select("key", "band", "mean"), ["key", "band"]).withColumn("away", away).where(F.col("away") <= reach)
    return found.groupBy("key", "event_id").agg(F.min_by(F.struct("band", "away"), F.struct(F.round("away", 9), "band")).alias("w")).select("key", "event_id", "w.band", F.round("w.away", 6).alias("away"))


def replay_clock(frames: DataFrame, step_us: int) -> DataFrame:
    """Replay time of recorded frames in event order: summed deltas; a step back counts as ``step_us`` and a break."""
    w = Window.partitionBy("key").orderBy("event_id")
    delta = F.col("us") - F.lag("us").over(w)
    back = delta < 0
    rows = frames.withColumn("break", F.coalesce(back, F.lit(False))).withColumn("step", F.coalesce(F.when(back, F.lit(step_us)).otherwise(delta), F.lit(0)))
    return rows.withColumn("clock", F.sum("step").over(w))
