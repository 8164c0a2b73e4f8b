"""Queries of the training-data operators over the driver's tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayeslsh, crossparse, factor, harmonic, iblt, interleave, oracles, outliers, raking, sst, urlblock
from .common import table
from .tokens import vocabulary


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.read_token_shards(sst.write_token_shards(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))


def op2_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlblock.judge(table(spark, sf_dir, "pages"))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).withColumn("d2", F.round("d2", 6))


def op4_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crossparse.identify(docs, crossparse.learn(docs))


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(table(spark, sf_dir, "documents"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factor.score(docs, factor.learn(docs, table(spark, sf_dir, "labels")))


def op9_bayes_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayeslsh.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleave(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
