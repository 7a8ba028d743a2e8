"""Running totals and progress of a crawl from a stream of saved pages (ts, source, bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GIB = 1024**3


def running_total(pages: DataFrame) -> DataFrame:
    """(source, pages, bytes) so far; for update or complete mode."""
    return pages.groupBy("source").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"))


def rates(pages: DataFrame, every: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """(window, pages, bytes) of tumbling windows; a window closes when ``late`` has passed."""
    return pages.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"))


def look_back(pages: DataFrame, width: str = "60 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, source, pages, bytes) of sliding windows."""
    return pages.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "source").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"))


def once(urls: DataFrame, late: str = "7 days") -> DataFrame:
    """Each url of a stream (ts, url) once, with state kept for ``late``."""
    return urls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])


def duration(seconds: float | None) -> str:
    """1h39m, 5m07s, 12s, or ? if unknown."""
    if seconds is None or seconds < 0 or seconds != seconds or seconds == float("inf"):
        return "?"
    s = int(seconds)
    if s >= 3600:
        return f"{s // 3600}h{s % 3600 // 60:02d}m"
    return f"{s // 60}m{s % 60:02d}s" if s >= 60 else f"{s}s"


def remaining(target_bytes: float, start_bytes: float, now_bytes: float, elapsed: float) -> str:
    """Time left to the target at the average rate since the start."""
    left, done = target_bytes - now_bytes, now_bytes - start_bytes
    if left <= 0:
        return duration(0)
    return duration(left * elapsed / done if done > 0 and elapsed > 0 else None)


def stop_at(query: StreamingQuery, total_bytes, target_bytes: float, free_bytes=None, least_free: float = 2 * GIB) -> bool:
    """Stop a query once the target is met or the disk is nearly full; total_bytes and free_bytes are functions."""
    if total_bytes() >= target_bytes or (free_bytes is not None and free_bytes() < least_free):
        query.stop()
        return True
    return False
