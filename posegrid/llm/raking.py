"""Mixing by iterative proportional fitting, then sampling with calibrated probabilities.

Tokens (words) are summed by cell of source, language and topic. Cell weights are raked: scaled in turn so that each
source's, language's and topic's weighted tokens meet its target share, until all meet it to TOLERANCE. Targets that
contradict each other have no solution, and some are only met in the limit: sweeps also end when one lessens the
greatest error by less than a tenth. A document is drawn with the probability min(1, c * weight) of its cell, where c makes the expected
tokens ``budget`` of all; its design weight (weight over probability) makes the sample meet the targets in
expectation. Targets are shares given by value, or the tokens' own shares to the power ``temper``. Documents only meet
in sums with map-side combine, so a hot source costs no more than another; what iterates is the table of cells, as
DataFrames, and each sweep's table goes when the next is written.

The topic is the text's form by the fixed patterns of ``topic_of``; pass a column to use another. A null text has no
tokens and topic ``none``; null sources and languages are values of their own. The draw is a hash of seed and id: a
repeated id is drawn once for all its rows, and so are rows without an id. Cells without tokens keep weight 1. Extra
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, settle_and_watch

TOLERANCE, TEMPER, BUDGET, SEED = 1e-9, 0.7, 0.8, 23
KEYS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    return F.when(text.isNull(), "none").when(text.contains(" | "), "table").when(text.rlike("[0-9]{3}"), "records").when(text.contains("\n"), "article").otherwise("note")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = SEED) -> list[Column]:
    """Columns mix_id, mix_source, mix_lang, mix_topic, mix_tokens and mix_unit (the draw, in [0, 1))."""
    text = F.col(text_col).cast("string")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    return [F.col(id_col).cast("long").alias("mix_id"), named(F.col(source_col)).alias("mix_source"), named(F.col(lang_col)).alias("mix_lang"), (topic_of(text) if topic is None else named(topic)).alias("mix_topic"), words.alias("mix_tokens"), unit.alias("mix_unit")]


def rake(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, tokens, raked, probability) of each cell of rows with ``described`` columns."""
    keys = [f"mix_{k}" for k in KEYS]
    cells = settle(rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")).withColumn("raked", F.lit(1.0)), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = []
    for key in keys:
        margin = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("of_key"))
        fixed = (targets or {}).get(key[4:])
        share = F.coalesce(*[F.when(F.col(key) == "=" * (key != "mix_topic") + k, F.lit(float(v))) for k, v in fixed.items()], F.lit(0.0)) if fixed else F.pow("of_key", F.lit(temper))
        margin = margin.withColumn("share", F.when(F.col("of_key") > 0, share).otherwise(0.0))
        whole = margin.agg(F.sum("share")).first()[0] or 1.0
        goals.append(settle(margin.select(key, (F.col("share") / whole * float(total)).alias("goal")), "goal"))
    error, before = 1e9, 1e10
    while tolerance < error < 0.9 * before:
        swept = cells.select(*keys, "tokens", "raked", F.lit(0.0).alias("error"))
        for key, goal in zip(keys, goals):
            now = swept.groupBy(key).agg(F.sum(F.col("tokens") * F.col("raked")).alias("now")).join(goal, key)
            ratio = now.select(key, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("ratio"))
            swept = swept.join(ratio, key).select(*keys, "tokens", (F.col("raked") * F.col("ratio")).alias("raked"), F.greatest("error", F.abs(F.col("ratio") - 1)).alias("error"))
        last, before = cells, error
        cells, seen = settle_and_watch(swept, "cells", error=F.max("error"))
        error = seen["error"] or 0.0
        discard(last)
    c, before = budget, 0.0
    while c > before * (1 + 1e-12):
        capped, before = F.col("raked") * c >= 1, c
        free, full = cells.agg(F.sum(F.when(~capped, F.col("tokens") * F.col("raked"))), F.sum(F.when(capped, F.col("tokens")))).first()
        c = max(c, (budget * total - (full or 0)) / free) if free else c
    return cells.drop("error").withColumn("probability", F.least(F.lit(1.0), F.col("raked") * F.lit(float(c))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, source, lang, topic, n_tokens, raked, probability, weight, sampled."""
    keys = [f"mix_{k}" for k in KEYS]
    rows = settle(docs.select(*described(docs)), "described")
    drawn = rows.join(rake(rows, **options), keys)
    value = lambda c: F.when(F.col(c) != "", F.substr(F.col(c), F.lit(2))).alias(c[4:])
    p = F.col("probability")
    return drawn.select(F.col("mix_id").alias("doc_id"), value("mix_source"), value("mix_lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
                        F.round("raked", 6).alias("raked"), F.round(p, 6).alias("probability"), F.round(F.when(p > 0, F.col("raked") / p), 6).alias("weight"), (F.col("mix_unit") < p).alias("sampled"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns."""
    keys = [f"mix_{k}" for k in KEYS]
    described_ = settle(docs.select(*described(docs)), "described")
    model = rake(described_, **options).select(*keys, "probability")
    discard(described_)
    rows = docs.select(F.struct("*").alias("doc"), *described(docs))
    return rows.join(model, keys).where("mix_unit < probability").select("doc.*")
