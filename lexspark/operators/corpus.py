"""Corpus statistics and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import tables
from lexspark.functions.layout import spread
from lexspark.functions.text import report_words, word_count

NULL_LABEL = "(null)"


def word_frequencies(docs: DataFrame) -> DataFrame:
    """(word, freq) over all texts."""
    return spread(docs.select("text")).select(F.explode(report_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def report_stopword(word: Column) -> Column:
    return (F.length(word) < tables.REPORT_MIN_LENGTH) | word.isin(*sorted(tables.REPORT_STOPWORDS))


def ranked(freq: DataFrame, n: int = 1000) -> DataFrame:
    """(rank, word, freq, reference): the n most frequent words and Zipf's line f1 / rank.

    The limit runs before the ranking, so only n rows meet in one partition.
    """
    best = freq.orderBy(F.desc("freq"), "word").limit(n)
    w = Window.orderBy(F.desc("freq"), "word")
    out = best.withColumn("rank", F.row_number().over(w))
    return out.select("rank", "word", "freq", F.round(F.first("freq").over(w) / F.col("rank"), 9).alias("reference"))


def totals(docs: DataFrame, freq: DataFrame) -> DataFrame:
    """One row: docs, missing texts, bytes, words, distinct words."""
    d = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("text").isNull()).alias("missing"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    w = freq.agg(F.sum("freq").alias("words"), F.count("*").alias("distinct_words"))
    return d.crossJoin(w)  # one row each


def grouped(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(kind, key, docs, words, bytes) for each of several keys in one pass, as grouping sets; a null key is labelled."""
    rows = spread(docs).select(*(F.coalesce(c.cast("string"), F.lit(NULL_LABEL)).alias(k) for k, c in keys.items()), F.size(report_words(F.col("text"))).alias("_words"), F.octet_length(F.coalesce("text", F.lit(""))).alias("_bytes"))
    kind = F.lit(None).cast("string")
    for k in keys:
        kind = F.when(F.grouping(k) == 0, k).otherwise(kind)
    key = F.coalesce(*(F.when(F.grouping(k) == 0, F.col(k)) for k in keys))
    return rows.groupingSets([[k] for k in keys], *keys).agg(kind.alias("kind"), key.alias("key"), F.count("*").alias("docs"), F.sum("_words").alias("words"), F.sum("_bytes").alias("bytes")).select("kind", "key", "docs", "words", "bytes")


def progress(pages: DataFrame, now: Column) -> DataFrame:
    """Per source: pages and bytes in all, in the last 10 and 60 minutes before now. pages: (source, fetched_at, bytes)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    inside = lambda minutes: age <= minutes * 60_000_000
    return pages.groupBy("source").agg(
        F.count("*").alias("pages"),
        F.sum("bytes").alias("bytes"),
        F.count_if(inside(10)).alias("pages_10m"),
        F.count_if(inside(60)).alias("pages_60m"),
        F.coalesce(F.sum(F.when(inside(60), F.col("bytes"))), F.lit(0)).alias("bytes_60m"),
    )


def largest(pages: DataFrame, key: str, n: int = 15) -> DataFrame:
    """The n values of a key with most bytes, and their share of all."""
    sums = pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"))
    total = pages.agg(F.sum("bytes").alias("total"))
    return sums.orderBy(F.desc("bytes"), key).limit(n).crossJoin(total).select(key, "pages", "bytes", F.round(F.col("bytes") / F.col("total") * 100, 6).alias("share"))


def thin(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Documents of fewer words, which are followed but not kept."""
    return docs.withColumn("words", word_count(F.col("text"))).where(F.col("words") < least_words)


def report_parts(docs: DataFrame, most_domains: int = 20, most_words: int = 50) -> DataFrame:
    """(part, key, docs, words, bytes) of a corpus report over docs (text, source, language, domain): totals, groups, the domains with most bytes, the commonest words."""
    freq = word_frequencies(docs)
    sums = grouped(docs, {"all": F.lit("all"), "source": F.col("source"), "language": F.col("language"), "domain": F.col("domain")}).withColumnRenamed("kind", "part")
    domains = sums.where("part = 'domain'").orderBy(F.desc("bytes"), "key").limit(most_domains)
    words = lambda df, part: df.orderBy(F.desc("freq"), "word").limit(most_words).select(F.lit(part).alias("part"), F.col("word").alias("key"), F.lit(0).cast("long").alias("docs"), F.col("freq").alias("words"), F.lit(0).cast("long").alias("bytes"))
    return sums.where("part <> 'domain'").unionByName(domains).unionByName(words(freq, "word")).unionByName(words(freq.where(~report_stopword(F.col("word"))), "plain_word"))


def crawled_pages(**crawlers: DataFrame) -> DataFrame:
    """Pages of several crawlers as one table, each row with the name of its crawler; columns that one lacks are null."""
    parts = [pages.withColumn("crawler_source", F.lit(name)) for name, pages in crawlers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
