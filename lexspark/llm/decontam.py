"""Benchmark decontamination in DataFrame functions only.

Every window of the benchmark's words is hashed into a small table which is broadcast
if it is within ``max_broadcast`` rows and MOST_CHARS characters; the documents' windows are hashed where they lie,
looked up, and hits are verified word by word. Where the benchmark's words are at most
MOST_WORDS, windows whose first, middle or last word it never uses are passed over
unhashed. A larger benchmark is looked up without that, and joins by shuffle, with the
same result. Only hits and one row a document are shuffled.

Defined results: a null text has no words; an item without words has no window; rows of
equal ``doc_id`` and text are grouped and returned as often as they occur; an item id that
occurs twice is one item, a missing one is the empty string; columns other than those
named are not read; an empty benchmark leaves every document clean, an empty table gives
an empty result; long texts are scanned in stretches of STRETCH words that overlap by
the window, so no array grows with the square of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.layout import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRETCH = 4096
MOST_WORDS = 20_000


def words(text: Column) -> Column:
    """Runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(h, len, gram, items): each distinct window with the items that have it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(window)))
    grams = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len")))).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("gram"))


def known_words(benchmark: DataFrame) -> Column | None:
    """Which of ``words`` the benchmark uses, as an array; None if it uses more than MOST_WORDS."""
    used = benchmark.select(F.explode(words(F.col("text"))).alias("w")).distinct().limit(MOST_WORDS + 1).collect()
    if len(used) > MOST_WORDS:
        return None
    listed = ", ".join(f"'{w}'" for w in sorted(r["w"] for r in used)) or "NULL"  # words hold no quotes
    return F.expr(f"transform(words, w -> coalesce(w IN ({listed}), false))")


#: Characters that a benchmark's windows may have, in all, to be broadcast.
MOST_CHARS = 200_000_000


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 8, max_broadcast: int = 1_000_000) -> DataFrame:
    """One row a document and, besides, one for each verified occurrence of a window.

    Columns doc_id, k, n_words, pos (-1 in the document's own row), len, items.
    """
    grams = benchmark_windows(benchmark, window)
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most ``window`` numbers
    size = grams.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", " "))).alias("chars")).first()
    small = size["n"] <= max_broadcast and (size["chars"] or 0) <= MOST_CHARS
    base = spread(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("k"), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    known = known_words(benchmark)
    if known is not None:
        base = base.withColumn("known", known)
    base = base.withColumn("from", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(STRETCH))))

    def scan(length: int) -> Column:
        last = F.least(F.col("from") + STRETCH, F.col("n_words") - length + 1)
        there = F.sequence(F.col("from"), F.greatest(last - 1, F.col("from")))
        if known is not None:
            there = F.filter(there, lambda i: F.get("known", i) & F.get("known", i + length - 1) & F.get("known", i + length // 2))
        found = F.transform(there, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice("words", i + 1, length)).alias("h")))
        return F.when(last > F.col("from"), found).otherwise(F.expr("array()").cast("array<struct<pos:int,len:int,h:bigint>>"))

    own = F.when(F.col("from") == 0, F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h")))).otherwise(F.expr("array()").cast("array<struct<pos:int,len:int,h:bigint>>"))
    rows = base.select("doc_id", "k", "n_words", "words", F.inline(F.concat(own, *(scan(n) for n in lengths))))
    gram = F.slice("words", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("len"))
    right = grams.select(F.col("h").alias("gh"), F.col("len").alias("glen"), F.col("gram"), "items")
    if small:
        right = F.broadcast(right)
        on = (F.col("h") == F.col("gh")) & (F.col("len") == F.col("glen")) & (gram == F.col("gram"))
    else:
        rows = rows.withColumn("g", F.when(F.col("pos") >= 0, gram)).drop("words")
        on = (F.col("h") == F.col("gh")) & (F.col("len") == F.col("glen")) & (F.col("g") == F.col("gram"))
    return rows.join(right, on, "left").where("pos < 0 OR items IS NOT NULL").select("doc_id", "k", "n_words", "pos", "len", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, max_broadcast: int = 1_000_000) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, window, max_broadcast)
    grouped = found.groupBy("doc_id", "k").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(F.col("pos") < 0, 1)).cast("int").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, span: Column) -> Column:
        end = F.greatest(acc["end"], span["pos"] + span["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], span["pos"])).alias("n"))

    covered = F.aggregate("spans", zero, add, lambda acc: acc["n"])
    out = grouped.select("doc_id", "n_words", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy").withColumn("contaminated", F.col("n_items") >= min_items)
