"""Page repository and crawl frontier as state tables: each operation maps the table to the next one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexspark.functions.text import is_topical, topical_score, word_count
from lexspark.functions.urls import domain
from lexspark.storage import drop, kept

ATTEMPTS, BACKOFF, MOST_BACKOFF = 3, 30, 900
BLOCK_AFTER = 25
BATCH = 200
#: Stretches of time in which the holders of a content are counted apart.
TIME_PARTS = 64
FEW_ARRIVALS = 200_000


def saved_in_order(events: DataFrame) -> DataFrame:
    """(url, _born) of new URLs by walking few events (url, h, _at) in order, in one task."""
    kind = events.schema["_at"].dataType["seq"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        holders: Counter = Counter()
        for batch in batches:
            born = []
            for url, h, at in zip(*(batch.column(c).to_pylist() for c in ("url", "h", "_at")), strict=True):
                if at["_new"] and url not in held:
                    if holders[h]:
                        continue
                    born.append((url, at["seq"]))
                if url in held:
                    holders[held[url]] -= 1
                held[url] = h
                holders[h] += 1
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in born], pa.string()), pa.array([s for _, s in born], to_arrow_type(kind))], ["url", "seq"])

    walked = events.select("url", "h", "_at").repartition(1).sortWithinPartitions("_at").mapInArrow(run, f"url string, seq {kind.simpleString()}")
    return walked.select("url", F.struct(F.lit(1).alias("_new"), "seq").alias("_born"))


def save_outcomes(arrivals: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Arrivals (seq, url, content_hash, ...) with ``outcome``, as if they were saved one by one, by seq, onto pages (url, content_hash).

    unchanged: the URL is there with this content; updated: with another, which it held until now;
    duplicate_content: a new URL whose content some URL holds at that moment; else saved.

    Whether a URL holds a content at some moment depends only on when it was first saved: from
    then on it holds what arrived last. So only the first saves are looked for, in rounds; each
    decides all arrivals whose content is certainly held, or certainly not, by URLs decided before.
    The number of rounds is the longest chain of such decisions. The holders of a content are
    counted by prefix sums over TIME_PARTS stretches of time, so a content in a third of all
    arrivals is no single sorted run. Up to FEW_ARRIVALS are walked in order in one task instead,
    with the same result.
    """
    columns = arrivals.columns
    rows = arrivals.withColumn("_new", F.lit(1))
    if pages is not None:
        old = pages.select(F.lit(None).cast(arrivals.schema["seq"].dataType).alias("seq"), "url", "content_hash", F.lit(0).alias("_new"))
        rows = old.unionByName(rows, allowMissingColumns=True)
    by_url = Window.partitionBy("url").orderBy("_at")
    tiles = rows.withColumn("_at", F.struct("_new", "seq")).withColumns({"_next": F.lead("_at").over(by_url), "_held": F.lag("content_hash").over(by_url)})
    tiles = kept(tiles, "arrivals")
    cuts = tiles.select(F.col("seq").cast("double").alias("t")).approxQuantile("t", [i / TIME_PARTS for i in range(1, TIME_PARTS)], 0.25 / TIME_PARTS)
    part = lambda at: F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= at["seq"].cast("double"))) if cuts else F.lit(0)

    events = tiles.select("url", F.col("content_hash").alias("h"), "_at", "_next")
    births = kept(events.where("_at._new = 0").select("url", F.col("_at").alias("_born")), "births")
    open_ = kept(events.where("_at._new = 1").join(births, "url", "left_anti"), "open")  # arrivals of URLs not saved yet, as far as known
    small = events.limit(FEW_ARRIVALS + 1).count() <= FEW_ARRIVALS
    if small:
        births = births.unionByName(saved_in_order(events))
    while not small and not open_.isEmpty():
        asked = open_.select("h").distinct()
        sure = events.join(births, "url").where("_at >= _born").join(asked, "h", "left_semi").select("url", "h", "_at", "_next", F.lit(True).alias("sure"))
        every = sure.unionByName(open_.withColumn("sure", F.lit(False)))
        steps = F.array(F.struct(F.col("_at").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("n")), F.struct(F.col("_next").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("n")))
        steps = every.select("url", "h", "sure", F.inline(steps)).where("at IS NOT NULL").withColumn("part", part(F.col("at")))
        here = {"sure_n": F.when(F.col("sure"), F.col("n")).otherwise(0), "n": F.col("n")}
        sums = steps.groupBy("h", "part").agg(*(F.sum(v).alias(k) for k, v in here.items()))
        before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("h", "part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in here))
        inside = Window.partitionBy("h", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
        counted = steps.withColumns({f"{k}_here": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in here.items()}).where("kind = 1 AND NOT sure").join(sums, ["h", "part"])
        left = counted.where(F.col("sure_n_before") + F.col("sure_n_here") == 0)
        left = kept(left.groupBy("url").agg(F.min("at").alias("first"), F.min_by(F.col("n_before") + F.col("n_here") == 0, "at").alias("free")), "left")
        after = kept(births.unionByName(left.where("free").select("url", F.col("first").alias("_born"))), "births")
        # what a URL would hold after its first open arrival counts as perhaps held, also where that arrival itself would be a duplicate
        still = kept(open_.join(left.where("NOT free").select("url", "first"), "url").where("_at >= first").drop("first"), "open")
        drop(births, open_, left)
        births, open_ = after, still
    drop(open_)
    out = tiles.where("_new = 1").join(births, "url", "left")
    late = F.col("_at") > F.col("_born")
    outcome = F.when(late & F.col("_held").eqNullSafe(F.col("content_hash")), "unchanged").when(late, "updated").when(F.col("_at") == F.col("_born"), "saved").otherwise("duplicate_content")
    return out.withColumn("outcome", outcome).select(*columns, "outcome")


def duplicates(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages whose content_hash is known."""
    return pages.join(known.select("content_hash").distinct(), "content_hash", "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: rows replace those of table with the same keys; within rows the highest ``order`` does."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    every = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def page_decision(pages: DataFrame, mode: Column, depth: Column, keywords: list[str] | None = None, least_words: int = 50) -> DataFrame:
    """Pages with hits, density, ``saved`` and ``follow``: thin pages are not saved but followed; pages off the subject of a topical host, below depth 0, are neither."""
    score = topical_score(F.col("text"), keywords)
    rows = pages.withColumn("_score", score).withColumn("topical", is_topical(F.col("_score")))
    thin = word_count(F.col("text")) < least_words
    off = (mode == "topical") & (depth > 0) & ~F.col("topical")
    reason = F.when(thin, "thin").when(off, "off_topic")
    return rows.withColumn("reason", reason).withColumn("saved", reason.isNull()).withColumn("hits", F.col("_score.hits")).withColumn("density", F.col("_score.density")).drop("_score")


def enqueue(frontier: DataFrame, found: DataFrame, max_depth: int = 6, per_domain: int = 100_000) -> DataFrame:
    """New tasks from found (seq, url, depth, ...): not deeper than allowed, each URL once, not yet in the frontier, and within the domain's cap in order of arrival."""
    w = Window.partitionBy("url").orderBy("seq")
    fresh = found.where(F.col("depth") <= max_depth).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    fresh = fresh.join(frontier.select("url"), "url", "left_anti").withColumn("domain", domain(F.col("url")))
    have = frontier.groupBy("domain").agg(F.count("*").alias("_have"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy("seq", "url"))
    admitted = fresh.withColumn("_place", place).join(have, "domain", "left").where(F.col("_place") + F.coalesce("_have", F.lit(0)) <= per_domain)
    return admitted.drop("_place", "_have").withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def claim(frontier: DataFrame, batch: int = BATCH) -> DataFrame:
    """The next tasks of each domain: pending, by depth and order of arrival."""
    w = Window.partitionBy("domain").orderBy("depth", "seq")
    return frontier.where("status = 'pending'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= batch)


def hard_failure(status: Column, error: Column) -> Column:
    return error.isNotNull() | status.isNull() | status.isin(403, 429) | (status >= 500)


def backoff(attempts: Column, retry_after: Column) -> Column:
    """Seconds to wait before an attempt is repeated."""
    return F.coalesce(F.when(retry_after.isNotNull(), F.greatest(retry_after, F.lit(0.0))), F.least(F.lit(float(MOST_BACKOFF)), BACKOFF * F.pow(F.lit(2.0), attempts - 1)))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds from a Retry-After header: a number or an HTTP date; never below 0; null if neither."""
    when = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    number = F.when(header.rlike(r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$"), F.trim(header).try_cast("double"))
    seconds = F.coalesce(number, (F.unix_timestamp(when) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def fetch_outcome(results: DataFrame) -> DataFrame:
    """Results (status_code, error, has_body, attempts, retry_after) with status, reason, success and wait.

    Errors and 429/503 are retried up to ATTEMPTS, then are errors; other statuses beyond 2xx are
    skipped, failures if 403 or 5xx; a body of a wrong kind is skipped; the rest is done.
    """
    code, attempts = F.col("status_code"), F.col("attempts") + 1
    again = F.col("error").isNotNull() | code.isin(429, 503)
    gone = attempts >= ATTEMPTS
    bad = ~code.between(200, 299)
    status = F.when(again & gone, "error").when(again, "pending").when(bad, "skipped").when(~F.col("has_body"), "skipped").otherwise("done")
    reason = F.when(F.col("error").isNotNull(), "fetch_error").when(code.isin(429, 503), F.concat(F.lit("http_"), code)).when(bad, F.concat(F.lit("http_"), code)).when(~F.col("has_body"), "content_type")
    success = ~(again | (bad & ((code == 403) | (code >= 500))))
    return results.withColumn("new_status", status).withColumn("reason", reason).withColumn("success", success).withColumn("wait", F.when(again & ~gone, backoff(attempts, F.col("retry_after"))))


def failure_runs(results: DataFrame, block_after: int = BLOCK_AFTER) -> DataFrame:
    """(domain, longest, blocked): longest run of failures in a row, reset by a success. results: (domain, seq, failed)."""
    w = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    islands = results.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w))
    runs = islands.groupBy("domain", "island").agg(F.count_if("failed").alias("run"))
    return runs.groupBy("domain").agg(F.max("run").alias("longest")).withColumn("blocked", F.col("longest") >= block_after)


def drain(frontier: DataFrame, blocked: DataFrame) -> DataFrame:
    """The frontier with what is open of blocked domains skipped."""
    marked = frontier.join(blocked.select("domain", F.lit(True).alias("_blocked")), "domain", "left")
    open_ = F.col("_blocked") & F.col("status").isin("pending", "in_progress")
    return marked.withColumn("status", F.when(open_, "skipped").otherwise(F.col("status"))).withColumn("last_reason", F.when(open_, "domain_blocked")).drop("_blocked")


def reset_in_progress(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def stale(pages: DataFrame, now: Column, days: float) -> DataFrame:
    """Pages fetched at least so many days ago."""
    return pages.where((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 86_400_000_000 >= days)


def revisit(frontier: DataFrame, pages: DataFrame, now: Column, days: float) -> DataFrame:
    """The frontier with finished tasks of stale pages pending again."""
    old = stale(pages, now, days).select("url").distinct().withColumn("_stale", F.lit(True))
    return frontier.join(old, "url", "left").withColumn("status", F.when((F.col("status") == "done") & F.col("_stale"), "pending").otherwise(F.col("status"))).drop("_stale")


def resume_filter(requests: DataFrame, pages: DataFrame, now: Column, crawler: str, days: float = 7) -> DataFrame:
    """Requests (url, depth, scope_rule, forced) without those this crawler saved lately, with status 2xx, from no greater depth and under the same rule."""
    lately = pages.where((F.col("crawler_source") == crawler) & F.col("http_status").between(200, 299) & F.col("text").isNotNull()).where((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 86_400_000_000 <= days)
    lately = lately.select("url", F.col("depth").alias("_depth"), F.col("scope_rule").alias("_rule"))
    skip = (requests["url"] == lately["url"]) & (requests["depth"] >= lately["_depth"]) & requests["scope_rule"].eqNullSafe(lately["_rule"]) & ~requests["forced"]
    return requests.join(lately, skip, "left_anti")


def mark(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """The frontier with the status and reason of results (url, new_status, reason); a task that goes back to pending has one attempt more."""
    found = results.select("url", "new_status", F.col("reason").alias("_reason"))
    joined = frontier.join(found, "url", "left")
    again = (F.col("new_status") == "pending").cast("int")
    return joined.withColumn("attempts", F.col("attempts") + F.coalesce(again, F.lit(0))).withColumn("status", F.coalesce("new_status", "status")).withColumn("last_reason", F.when(F.col("new_status").isNotNull(), F.col("_reason"))).drop("new_status", "_reason")


def new_links(found: DataFrame, admitted: DataFrame) -> DataFrame:
    """Links (from_url, to_url) to keep: those whose target was just admitted to the frontier."""
    return found.join(admitted.select(F.col("url").alias("to_url")).distinct(), "to_url", "left_semi").select("from_url", "to_url")


def by_status(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count("*").alias("urls"))


def domain_counts(frontier: DataFrame) -> DataFrame:
    """(domain, urls, pending)."""
    return frontier.groupBy("domain").agg(F.count("*").alias("urls"), F.count_if(F.col("status") == "pending").alias("pending"))


def shown_only(judgements: DataFrame, shown: DataFrame) -> DataFrame:
    """Judgements that are valid: grade 0, 1 or 2, of a page the run showed."""
    return judgements.where(F.col("relevance").isin(0, 1, 2)).join(shown.select("run_id", "page_id").distinct(), ["run_id", "page_id"], "left_semi")
