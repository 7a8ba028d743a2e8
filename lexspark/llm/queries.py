"""The operators as named queries over whole tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import oracles
from lexspark.llm.decontam import decontaminate
from lexspark.llm.htmlmain import extract
from lexspark.llm.langid import page_languages
from lexspark.llm.licenses import scan_licences
from lexspark.llm.neardup import near_duplicates
from lexspark.llm.packing import pack
from lexspark.llm.quality import score_quality
from lexspark.llm.repetition import repetition_rules
from lexspark.llm.substring import substring_dedup
from lexspark.llm.urlfilter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=20)


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8, min_items=2)


OPERATORS = (op1_quality, op2_packing, op3_minhash, op4_licences, op5_substring, op6_repetition, op7_language, op8_urlfilter, op9_maintext, op10_decontamination)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring": oracles.SUBSTRING, "op6_repetition": oracles.REPETITION, "op10_decontamination": oracles.DECONTAMINATION}
