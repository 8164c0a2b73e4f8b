"""Ordered deals: key ranges of about equal row counts, and the partitions that hold them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(ids: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts-1 ascending bounds that cut the integer ``key`` into ranges of about equal row counts."""
    at = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx(key, at, 10_000).alias("b")).first()["b"] if at else []
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """0-based range of ``key`` (null: 0): how many bounds are below it."""
    limits = np.asarray(bounds, np.int64)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, x.to_numpy(np.int64), side="left").astype(np.int32))

    if not bounds:
        return F.lit(0)
    return place(F.coalesce(key.cast("long"), F.lit(-(1 << 63)).cast("long")))


def parts_of(df: DataFrame) -> int:
    """As many partitions as the session's shuffles have, which the cluster sizes by its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
