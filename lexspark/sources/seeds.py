"""Seed lists as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.urls import denied, host, normalize_url
from lexspark.operators.repository import upsert

COLUMNS = ("seed_id", "url", "subtema", "scope_mode", "idioma", "crawler")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an id and a url, everything trimmed; scope_mode is topical if not given."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return clean_seeds(spark.read.schema(schema).csv(path, header=True))


def clean_seeds(rows: DataFrame) -> DataFrame:
    out = rows.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in COLUMNS)).where("seed_id <> '' AND url <> ''")
    return out.withColumn("scope_mode", F.when(F.col("scope_mode") == "", "topical").otherwise(F.col("scope_mode")))


def for_crawler(seeds: DataFrame, name: str, all_seeds: bool = False) -> DataFrame:
    """Seeds of one crawler, and those of none."""
    return seeds if all_seeds else seeds.where(F.col("crawler").isin("", name))


def shared_hosts(seeds: DataFrame) -> DataFrame:
    """(host, crawlers) of hosts given to more than one crawler."""
    named = seeds.where("crawler <> ''").groupBy(host(F.col("url")).alias("host")).agg(F.array_sort(F.collect_set("crawler")).alias("crawlers"))
    return named.where(F.size("crawlers") > 1)


def start_tasks(seeds: DataFrame) -> DataFrame:
    """Frontier rows of depth 0 from seeds whose URL is valid and not denied; the start counts as topical."""
    url = normalize_url(F.col("url"))
    rows = seeds.select("seed_id", url.alias("url"), F.col("scope_mode").alias("scope_rule")).where("url IS NOT NULL")
    return rows.where(denied(F.col("url")).isNull()).select("*", F.lit(0).alias("depth"), F.lit(True).alias("parent_topical"))


def save_seeds(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seed table with new rows in it: a seed_id's last row (by ``seq``) replaces it."""
    return upsert(table.withColumn("seq", F.lit(-1).cast("long")), seeds, ["seed_id"], "seq").drop("seq")
