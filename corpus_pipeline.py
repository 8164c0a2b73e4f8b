"""The corpus pipeline: quality classifier, quality rules, near-dedup, mixing and packing of documents.

All stages take rows as they come: null ids, texts and other values, empty and very long texts, repeated ids and rows,
further columns of any name, and empty tables. Rows are told apart by their id and text. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import bayeslsh, factor, harmonic, outliers, raking
from posegrid.llm.common import settle, table
from posegrid.llm.tokens import vocabulary

_KEYS = ["key_id", "key_text"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("doc"), *_row_key())


def _row_key() -> list:
    return bayeslsh.row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; equal texts share a score."""
    machine = factor.learn(docs, table(spark, sf_dir, "labels"))
    good = factor.probability(spark, machine)(F.col("text").cast("string"))
    return docs.where(good >= 0.7)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Rows of one id and text in several languages or sources go together, if any of them goes. The rejected keys are
    written, so that Catalyst knows their size: it broadcasts them if they are few, and else shuffles.
    """
    judged = outliers.judge(docs, keep=_row_key())
    rejected = settle(judged.where("NOT kept").select(*_KEYS).distinct(), "rejected")
    return _keyed(docs).join(rejected, _KEYS, "left_anti").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): one of the smallest id.

    Of the rows of that id in the group, those of one text stay, and of equal rows of id and text one (any of them).
    Texts without a word are in no group: all such rows stay.
    """
    judged = settle(bayeslsh.grouped(docs, keep=_row_key()).select(*_KEYS, "component", "kept"), "judged")
    rivals = judged.where("kept AND component IS NOT NULL")
    again = settle(rivals.groupBy("component").agg(F.min(F.struct(*_KEYS)).alias("stay"), F.count("*").alias("n")).where("n > 1").select("component", "stay"), "again")
    others = rivals.join(again, "component").where(F.struct(*_KEYS) != F.col("stay")).select(*_KEYS)
    gone = settle(judged.where("NOT kept").select(*_KEYS).union(others).distinct(), "gone")
    left = _keyed(docs).join(gone, _KEYS, "left_anti")
    if not again.limit(1).count():
        return left.select("doc.*")
    repeated = again.select("stay.*")
    one = left.join(repeated, _KEYS, "left_semi").groupBy(*_KEYS).agg(F.first("doc").alias("doc"))
    return left.join(repeated, _KEYS, "left_anti").select("doc.*").union(one.select("doc.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the raked shares of source, language and topic; rows of one id share their draw."""
    return raking.sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 ids; a row a piece."""
    return harmonic.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
