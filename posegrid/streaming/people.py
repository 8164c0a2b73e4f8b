"""Tracked people of a stream: association, running confidence, expiry and cap, in a batch and in a stream."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "ids array<long>, at array<double>, first array<long>, last array<long>, n array<long>, next long"
RESULT = "key long, person long, position double, first_us long, last_us long, n long"


@dataclass(frozen=True)
class Rules:
    """reach: how far a person moves between frames; idle_us: expiry; most: people that stay."""

    reach: float = 0.5
    idle_us: int = 3 * 86_400_000_000
    most: int = 4


def fold(people: list[list], next_id: int, rows, rules: Rules) -> tuple[list[list], int]:
    """People are [id, position, first, last, n]; each sighting goes to the nearest person in reach or makes a new one."""
    for us, depth in rows:
        people = [p for p in people if us - p[3] <= rules.idle_us]
        near = min(((abs(p[1] - depth), p[0], i) for i, p in enumerate(people)), default=None)
        if near and near[0] <= rules.reach:
            p = people[near[2]]
            p[1], p[3], p[4] = depth, us, p[4] + 1
        else:
            people.append([next_id, depth, us, us, 1])
            next_id += 1
        people = sorted(sorted(people, key=lambda p: (-p[4], p[0]))[: rules.most], key=lambda p: (p[2], p[0]))
    return people, next_id


def _frame(key: int, people: list[list]) -> pd.DataFrame:
    return pd.DataFrame([(key, *p) for p in people], columns=[c.split()[0] for c in RESULT.split(", ")])


def batch_people(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["us", "event_id"])[["us", "depth"]].itertuples(index=False)
        return _frame(key[0], fold([], 0, rows, rules)[0])

    return frames.groupBy("key").applyInPandas(run, RESULT)


def stream_people(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    def run(key, batches, state: GroupState):
        people, next_id = [], 0
        if state.exists:
            *columns, next_id = state.get
            people = [list(p) for p in zip(*columns)]
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        people, next_id = fold(people, next_id, pdf[["us", "depth"]].itertuples(index=False), rules)
        state.update((*[[p[k] for p in people] for k in range(5)], next_id))
        yield _frame(key[0], people)

    return frames.groupBy("key").applyInPandasWithState(run, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)
