"""Codebook of depth codewords by key: the same fold in a batch and in a stream."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WORDS = "mean array<double>, n array<long>, created array<long>, seen array<long>, runs array<long>, frame array<long>, frames long"
RESULT = "key long, word int, mean double, n long, created long, seen long, runs long, frames long"


@dataclass(frozen=True)
class Rules:
    """reach: how far a match may lie; cap: most weight of a mean; ttl_us: a word unseen for so long retires."""

    reach: float = 0.05
    cap: int = 100
    ttl_us: int = 5 * 86_400_000_000
    reset_kind: str = "error"
    paused_kind: str = "none"


def fold(words: list[list], frames: int, rows: Iterator[tuple], rules: Rules) -> tuple[list[list], int]:
    """Words are [mean, n, created, seen, runs, last frame], near to far; rows are (us, kind, depth) in order.

    A break in the stream wipes the codebook; a paused frame changes nothing. A run is a match right after a match;
    the creating match starts the counter at 0.
    """
    means, oldest = [w[0] for w in words], min((w[3] for w in words), default=0)
    for us, kind, depth in rows:
        if kind == rules.paused_kind:
            continue
        if kind == rules.reset_kind:
            words, means, frames = [], [], 0
            continue
        frames += 1
        if words and us - oldest > rules.ttl_us:
            words = [w for w in words if us - w[3] <= rules.ttl_us]
            means, oldest = [w[0] for w in words], min((w[3] for w in words), default=us)
        at = bisect_left(means, depth)
        # The nearest word is beside the place of the depth; the nearer one to the camera on ties.
        near = min(((abs(means[i] - depth), i) for i in (at - 1, at) if 0 <= i < len(means)), default=(rules.reach + 1, -1))
        if near[0] <= rules.reach:
            w = words.pop(near[1])
            means.pop(near[1])
            n = min(w[1], rules.cap)
            w[0] = (w[0] * n + depth) / (n + 1)
            w[1], w[3] = w[1] + 1, us
            w[4] += w[5] == frames - 1 and w[1] > 2
            w[5] = frames
        else:
            w = [depth, 1, us, us, 0, frames]
        oldest = min(oldest, us) if words else us
        at = bisect_right(means, w[0])
        words.insert(at, w)
        means.insert(at, w[0])
    return words, frames


def _frame(key: int, words: list[list], frames: int) -> pd.DataFrame:
    return pd.DataFrame([(key, i, w[0], w[1], w[2], w[3], w[4], frames) for i, w in enumerate(words)], columns=[c.split()[0] for c in RESULT.split(", ")])


def batch_codebook(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The codebook of each key after all its frames; frames have key, event_id, us, kind, depth."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["us", "event_id"])[["us", "kind", "depth"]].itertuples(index=False)
        return _frame(key[0], *fold([], 0, rows, rules))

    return frames.groupBy("key").applyInPandas(run, RESULT)


def stream_codebook(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Codebooks as they change: the state of a key is its words."""

    def run(key, batches, state: GroupState):
        words, frames_seen = [], 0
        if state.exists:
            mean, n, created, seen, runs, frame, frames_seen = state.get
            words = [list(w) for w in zip(mean, n, created, seen, runs, frame)]
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        words, frames_seen = fold(words, frames_seen, pdf[["us", "kind", "depth"]].itertuples(index=False), rules)
        state.update((*[[w[k] for w in words] for k in range(6)], frames_seen))
        yield _frame(key[0], words, frames_seen)

    return frames.groupBy("key").applyInPandasWithState(run, RESULT, WORDS, "update", GroupStateTimeout.NoTimeout)
