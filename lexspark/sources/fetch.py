"""Fetching pages through a function the caller gives, and robots rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 5_000_000
CONTENT_TYPES = ("text/html", "application/xhtml+xml")
MOST_DELAY = 30.0
FETCHED = "url string, final_url string, status_code int, content_type string, body string, truncated boolean, error string, fetch_ms long"


def fetch(tasks: DataFrame, get: Callable[[str], dict]) -> DataFrame:
    """Results of get(url) for tasks (url), a batch of rows at a time on the executors.

    get returns status_code, content_type, final_url, body (bytes) and charset. Bodies of other
    kinds or statuses beyond 2xx are dropped, long ones are cut at MOST_BYTES; what get raises is
    the row's error. There is no network here: tests and offline runs pass a lookup.
    """

    def one(url: str) -> tuple:
        try:
            r = get(url)
        except Exception as e:  # a failed fetch is a result
            return url, None, None, None, None, False, f"{type(e).__name__}: {e}", None
        kind = (r.get("content_type") or "").split(";")[0].strip().lower()
        code, body = r.get("status_code"), r.get("body") or b""
        usable = code is not None and 200 <= code < 300 and kind in CONTENT_TYPES
        text = body[:MOST_BYTES].decode(r.get("charset") or "utf-8", "replace") if usable else None
        return url, r.get("final_url") or url, code, kind, text, len(body) > MOST_BYTES, None, r.get("fetch_ms")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in FETCHED.split(", ")]
        for frame in frames:
            yield pd.DataFrame([one(u) for u in frame["url"]], columns=names).astype({"status_code": "Int32", "fetch_ms": "Int64"})

    return tasks.select("url").mapInPandas(run, FETCHED)


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """Rules (site, path, allow) and delays (site, path null, delay) from robots files (site, status_code, text).

    The group of the agent counts if the file has one, else that of ``*``. A site whose file could not be
    had (status beyond 2xx, or no text) has no rules, and so allows all.
    """
    usable = files.where(F.col("status_code").between(200, 299) & F.col("text").isNotNull())
    lines = usable.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    parts = lines.select("site", "n", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("value")).where("key <> ''")
    w = Window.partitionBy("site").orderBy("n")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    parts = parts.withColumn("group", F.sum(starts.cast("int")).over(w))
    agents = parts.where("key = 'user-agent'").groupBy("site", "group").agg(F.max((F.lower("value") == agent.lower()).cast("int")).alias("mine"), F.max((F.col("value") == "*").cast("int")).alias("any"))
    best = agents.where("mine + any > 0").withColumn("named", F.max("mine").over(Window.partitionBy("site"))).where("mine = named").select("site", "group")
    own = parts.join(best, ["site", "group"]).where(F.col("key").isin("allow", "disallow", "crawl-delay") & (F.col("value") != ""))
    rule = F.col("key") != "crawl-delay"
    return own.select("site", F.when(rule, F.col("value")).alias("path"), F.when(rule, F.col("key") == "allow").alias("allow"), F.when(~rule, F.col("value").try_cast("double")).alias("delay"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, site, path) that robots rules (site, path, allow) let through: the longest rule that fits wins, allow on a tie; sites without rules allow all."""
    per_site = rules.where("path IS NOT NULL").groupBy("site").agg(F.collect_list(F.struct(F.length("path").alias("n"), "allow", F.col("path").alias("rule"))).alias("_rules"))  # one robots file each
    fitting = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["rule"]))
    return urls.join(per_site, "site", "left").where(F.coalesce(F.array_max(fitting)["allow"], F.lit(True))).select(urls.columns)


def crawl_delay(declared: Column, least: float = 1.0) -> Column:
    """Seconds between requests to a site: what its robots file asks, within bounds."""
    return F.greatest(F.lit(least), F.least(F.coalesce(declared, F.lit(0.0)), F.lit(MOST_DELAY)))
