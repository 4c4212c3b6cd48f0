"""The queries of this subpackage: thin calls of its operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op01_mix, op02_toxicity, op03_suffix, op04_ctw, op05_pack, op06_exact, op07_pii, op08_language, op09_caps
from . import op10_jaccard as op10_jaccard_module
from .common import table
from .sql import ORACLES


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_mix.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_suffix.report(table(spark, sf_dir, "documents"))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_ctw.report(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op05_pack.report(table(spark, sf_dir, "documents"), public_tokenizers.path(op05_pack.TOKENIZER))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_exact.report(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_pii.report(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_language.report(table(spark, sf_dir, "documents"))


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_caps.report(table(spark, sf_dir, "embeddings"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard_module.report(table(spark, sf_dir, "documents"))


def queries():
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_mix, op2_toxicity, op3_suffix, op4_ctw, op5_pack, op6_exact_dedup, op7_pii, op8_language, op9_caps, op10_jaccard)}


def oracle_sql():
    return dict(ORACLES)
