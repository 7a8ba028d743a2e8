"""What a crawl log tells about links that were left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.urls import denied, host, path


def omitted_links(lines: DataFrame) -> DataFrame:
    """URLs of pages (lines: value) that enqueued fewer links than were in scope."""
    part = lambda name, pattern=r"(\d+)": F.regexp_extract("value", rf"\bLINKS\b.*?\b{name}={pattern}", 1)
    rows = lines.select(part("url", r"(\S+)").alias("url"), part("in_scope").try_cast("int").alias("in_scope"), part("enqueued").try_cast("int").alias("enqueued"))
    return rows.where("url <> '' AND in_scope > enqueued").select("url").distinct()


def thin_pages(lines: DataFrame) -> DataFrame:
    """(url, depth) of pages skipped as thin, at their least depth."""
    part = lambda name, pattern: F.regexp_extract("value", rf"\bSKIP_THIN_CONTENT\b.*?\b{name}={pattern}", 1)
    rows = lines.select(part("url", r"(\S+)").alias("url"), part("depth", r"(\d+)").try_cast("int").alias("depth"))
    return rows.where("url <> ''").groupBy("url").agg(F.min("depth").alias("depth"))


def recovery_candidates(pages: DataFrame, omitted: DataFrame, rules: DataFrame, max_depth: int = 6) -> DataFrame:
    """Pages (url, depth) to visit again for their links: between the start and the depth limit, on an allowed host, not denied, prefix rules still met."""
    rows = pages.join(omitted.select("url"), "url", "left_semi").where((F.col("depth") > 0) & (F.col("depth") < max_depth))
    rows = rows.withColumn("_host", host(F.col("url"))).join(rules.select(F.col("host").alias("_host"), "mode", "prefixes"), "_host")
    rows = rows.where(denied(F.col("url")).isNull())
    inside = F.exists("prefixes", lambda p: F.startswith(path(F.col("url")), p))
    return rows.where((F.col("mode") != "prefix") | inside).drop("_host", "mode", "prefixes").orderBy("depth", "url")
