"""Queries over ordered frames of a key, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import decayed
from ..operators import history
from ..sources.adapters import stream, table, with_views

WIDTH = 0.25


def _frames(spark, sf_dir):
    return stream(spark, sf_dir)


def bounded_history(spark, sf_dir):
    return history.bounded_history(_frames(spark, sf_dir)).select("key", "event_id", "place")


def velocity_outlier(spark, sf_dir):
    rows = history.velocity_outliers(_frames(spark, sf_dir))
    return rows.select("key", "event_id", F.round("speed", 6).alias("speed"), F.round("mean_speed", 6).alias("mean_speed"), "outlier")


def velocity_replace(spark, sf_dir):
    return history.steadied(_frames(spark, sf_dir)).select("key", "event_id", F.round("steady", 6).alias("steady"), "outlier")


def last_valid_fill(spark, sf_dir):
    return history.last_valid(_frames(spark, sf_dir), F.col("kind") != "error").select("key", "event_id", F.round("filled", 6).alias("filled"))


def consecutive_runs(spark, sf_dir):
    return history.consecutive_runs(_frames(spark, sf_dir), F.col("kind") == "view")


def expire_and_topk(spark, sf_dir):
    return history.keep_top(_frames(spark, sf_dir), 86_400_000_000, 4)


def capped_running_mean(spark, sf_dir):
    return history.capped_mean(_frames(spark, sf_dir), 50).select("key", "n_frames", F.round("mean", 6).alias("mean"))


def time_step_sample(spark, sf_dir):
    return history.time_step_sample(_frames(spark, sf_dir), 6 * 3_600_000_000)


def frame_diff_filter(spark, sf_dir):
    return history.changed_frames(_frames(spark, sf_dir), 0.5).select("key", "event_id", F.round("depth", 6).alias("depth"))


def asof_bracket_lerp(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("request_id"), (F.lit(1704067200000000) + F.col("o_orderkey") * 7919 % 2505600 * 1000000).alias("us"))
    return history.bracketed(asked, frames.groupBy("key", "us").agg(F.max_by("depth", "event_id").alias("depth"))).select("key", "request_id", "before_us", "after_us", F.round("depth", 6).alias("depth"))


def decayed_timestamp(spark, sf_dir):
    ms = (F.col("us") % 1000000) / 1000.0 - 400
    return _frames(spark, sf_dir).select("event_id", F.round(decayed(ms, 100.0, 1.0), 6).alias("decayed_ms"))


def combine_latest(spark, sf_dir):
    return history.latest_of_kinds(_frames(spark, sf_dir), "view", "click")


def stage_durations(spark, sf_dir):
    return history.stage_durations(_frames(spark, sf_dir))


def codebook_background(spark, sf_dir):
    words = history.codewords(_frames(spark, sf_dir), WIDTH)
    return history.background_words(words).select("key", "band", F.round("mean", 6).alias("mean"), "n")


def codebook_classify(spark, sf_dir):
    words = history.codewords(_frames(spark, sf_dir), WIDTH)
    return history.classify(words, history.background_words(words), 0.05, 0.2, 5, 0.2)


def nearest_codeword(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return history.nearest_codeword(frames, history.codewords(frames, WIDTH), 0.05, WIDTH)


def replay_clock(spark, sf_dir):
    return history.replay_clock(_frames(spark, sf_dir), 16000).select("key", "event_id", "break", "clock")


_WORDS = """, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n_frame FROM stream),
w AS (SELECT key, CAST(floor(depth / 25e-2) AS BIGINT) AS band, avg(depth) AS mean, count(*) AS n, min(n_frame) AS first_frame, max(n_frame) AS last_frame FROM f GROUP BY 1, 2),
bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, round(mean, 9) DESC, band DESC) AS k FROM w) x WHERE k = 1)"""


def _stream(sql: str, recursive: bool = False) -> str:
    return with_views(sql, "stream", recursive=recursive)


_FOLD = ", f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS k FROM stream)"

ORACLES = {
    "bounded_history": _stream(" SELECT key, event_id, place FROM (SELECT key, event_id, CAST(row_number() OVER (PARTITION BY key ORDER BY us DESC, event_id DESC) AS INT) AS place FROM stream) x WHERE place <= 12"),
    "velocity_outlier": _stream(""", s AS (SELECT key, event_id, us, CASE WHEN us > lag(us) OVER w THEN abs(depth - lag(depth) OVER w) / ((us - lag(us) OVER w) / 1e6) * 1000 END AS speed FROM stream WINDOW w AS (PARTITION BY key ORDER BY us, event_id)),
        m AS (SELECT *, avg(speed) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean_speed FROM s)
        SELECT key, event_id, round(speed, 6) AS speed, round(mean_speed, 6) AS mean_speed, coalesce(speed > 15e-1 AND speed > 2e0 * mean_speed, false) AS outlier FROM m"""),
    "velocity_replace": _stream(""", s AS (SELECT key, event_id, us, depth, depth - lag(depth) OVER w AS moved, lag(depth) OVER w AS bd,
        CASE WHEN us > lag(us) OVER w THEN abs(depth - lag(depth) OVER w) / ((us - lag(us) OVER w) / 1e6) * 1000 END AS speed FROM stream WINDOW w AS (PARTITION BY key ORDER BY us, event_id)),
        m AS (SELECT *, avg(speed) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean_speed FROM s),
        o AS (SELECT *, coalesce(speed > 15e-1 AND speed > 2e0 * mean_speed, false) AS outlier FROM m)
        SELECT key, event_id, outlier, round(CASE WHEN outlier THEN bd + coalesce(last_value(CASE WHEN NOT outlier THEN moved END IGNORE NULLS)
            OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) ELSE depth END, 6) AS steady FROM o"""),
    "last_valid_fill": _stream(" SELECT key, event_id, round(last_value(CASE WHEN kind <> 'error' THEN depth END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled FROM stream"),
    "consecutive_runs": _stream(_FOLD + ", g AS (SELECT key, k - row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS island FROM f WHERE kind = 'view'), r AS (SELECT key, island, count(*) AS len FROM g GROUP BY 1, 2) SELECT key, count(*) AS n_runs, max(len) AS longest, CAST(sum(len) AS BIGINT) AS n_frames FROM r GROUP BY key"),
    "expire_and_topk": _stream(", b AS (SELECT key, min(us) AS first_us, max(us) AS last_us, round(sum(depth), 6) AS confidence FROM stream GROUP BY key) SELECT * FROM b WHERE (SELECT max(last_us) FROM b) - last_us <= 86400000000 ORDER BY confidence DESC, key LIMIT 4"),
    "capped_running_mean": _stream(_FOLD + ", c(key, k, mean, n) AS (SELECT key, 1, depth, 1 FROM f WHERE k = 1 UNION ALL SELECT c.key, c.k + 1, (mean * c.n + depth) / (c.n + 1), least(c.n + 1, 50) FROM c JOIN f ON f.key = c.key AND f.k = c.k + 1) SELECT key, CAST(max(k) AS BIGINT) AS n_frames, round(arg_max(mean, k), 6) AS mean FROM c GROUP BY key", True),
    "time_step_sample": _stream(", t(key, us, event_id) AS (SELECT key, us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS k FROM stream) x WHERE k = 1 UNION ALL SELECT key, us, event_id FROM (SELECT s.key, s.us, s.event_id, row_number() OVER (PARTITION BY s.key ORDER BY s.us, s.event_id) AS k FROM t JOIN stream s ON s.key = t.key AND s.us - t.us >= 21600000000) y WHERE k = 1) SELECT key, us, event_id FROM t", True),
    "frame_diff_filter": _stream(_FOLD + ", t(key, k, event_id, depth, kept) AS (SELECT key, 1, event_id, depth, true FROM f WHERE k = 1 UNION ALL SELECT f.key, f.k, f.event_id, CASE WHEN abs(f.depth - t.depth) >= 5e-1 * t.depth THEN f.depth ELSE t.depth END, abs(f.depth - t.depth) >= 5e-1 * t.depth FROM t JOIN f ON f.key = t.key AND f.k = t.k + 1) SELECT key, event_id, round(depth, 6) AS depth FROM t WHERE kept", True),
    "asof_bracket_lerp": _stream(""", q AS (SELECT o_custkey AS key, o_orderkey AS request_id, 1704067200000000 + o_orderkey * 7919 % 2505600 * 1000000 AS us FROM orders),
        f AS (SELECT key, us, arg_max(depth, event_id) AS depth FROM stream GROUP BY key, us),
        p AS (SELECT q.*, f.us AS before_us, f.depth AS before_depth FROM q ASOF LEFT JOIN f ON q.key = f.key AND q.us >= f.us),
        n AS (SELECT p.*, f.us AS after_us, f.depth AS after_depth FROM p ASOF LEFT JOIN f ON p.key = f.key AND p.us < f.us)
        SELECT key, request_id, before_us, after_us, round(CASE WHEN before_us IS NULL THEN after_depth WHEN after_us IS NULL THEN before_depth ELSE before_depth + (after_depth - before_depth) * ((us - before_us) / (after_us - before_us)) END, 6) AS depth FROM n"""),
    "decayed_timestamp": _stream(", m AS (SELECT event_id, (us % 1000000) / 1000e0 - 400 AS d FROM stream) SELECT event_id, round(CASE WHEN abs(d) <= 100 THEN d ELSE sign(d) * (100 + 100 * sqrt(least((abs(d) - 100) / 100e0, 1e0))) END, 6) AS decayed_ms FROM m"),
    "combine_latest": _stream(", v AS (SELECT *, last_value(CASE WHEN kind = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS other_id FROM stream WHERE kind IN ('view', 'click')) SELECT key, event_id, other_id FROM v WHERE kind = 'view'"),
    "stage_durations": _stream(", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY us DESC, event_id DESC) AS age FROM stream) x WHERE age <= 30), m AS (SELECT kind, value AS median FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY kind) AS c FROM l) y WHERE k = c // 2) SELECT kind, round(avg(value), 6) AS average, any_value(median) AS median, count(*) AS n FROM stream JOIN m USING (kind) GROUP BY kind"),
    "codebook_background": _stream(_WORDS + " SELECT key, band, round(mean, 6) AS mean, n FROM bg"),
    "codebook_classify": _stream(_WORDS + """ SELECT w.key, w.band, w.n, round(w.mean, 6) AS mean, CASE WHEN w.band = bg.band OR abs(w.mean - bg.mean) <= 5e-2 THEN 'BACKGROUND' WHEN abs(w.mean - bg.mean) <= 2e-1 THEN 'FLAT' WHEN w.n > 5 AND w.n * 1e0 / (w.last_frame - w.first_frame + 1) >= 2e-1 THEN 'IGNORED' ELSE 'FOREGROUND' END AS class FROM w JOIN bg ON bg.key = w.key"""),
    "nearest_codeword": _stream(_WORDS + " SELECT key, event_id, band, round(away, 6) AS away FROM (SELECT s.key, s.event_id, w.band, abs(s.depth - w.mean) AS away, row_number() OVER (PARTITION BY s.key, s.event_id ORDER BY round(abs(s.depth - w.mean), 9), w.band) AS k FROM stream s JOIN w ON w.key = s.key AND abs(s.depth - w.mean) <= 5e-2) x WHERE k = 1"),
    "replay_clock": _stream(", d AS (SELECT key, event_id, us - lag(us) OVER (PARTITION BY key ORDER BY event_id) AS d FROM stream) SELECT key, event_id, coalesce(d < 0, false) AS \"break\", CAST(sum(coalesce(CASE WHEN d < 0 THEN 16000 ELSE d END, 0)) OVER (PARTITION BY key ORDER BY event_id) AS BIGINT) AS clock FROM d"),
}

QUERIES = {f.__name__: f for f in (bounded_history, velocity_outlier, velocity_replace, last_valid_fill, consecutive_runs, expire_and_topk, capped_running_mean, time_step_sample, frame_diff_filter, asof_bracket_lerp, decayed_timestamp, combine_latest, stage_durations, codebook_background, codebook_classify, nearest_codeword, replay_clock)}
