"""Small inline tables, and relations the queries derive from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MONTHS_EN = "January Feb Mar April May June Jul August Sept October Nov December"
MONTHS_ES = "enero febrero marzo abr mayo junio julio agosto septiembre octubre nov diciembre"
#: (phrase, with names and thesaurus, with stop words out and stems too).
PHRASES = [
    ("Red Dead Redemption", "rdr", "rdr"),
    ("the Elder Scrolls games", "elderscrolls games", "elderscrol game"),
    ("elder scroll", "elder scroll", "elder scroll"),
    ("Hollow Knight's bosses", "hollowknight s bosses", "hollowknight boss"),
    ("shooter en primera persona", "fps", "fp"),
    ("requisitos mínimos", "minimum requirements", "minimum requir"),
    ("una co-op misión", "una coop quest", "coop quest"),
    ("", "", ""),
    ("running and generalizing", "running and generalizing", "run gener"),
]
SEEDS = [
    ("s1", "https://a.example.com/wiki/", "", "domain", "en", "custom"),
    ("s2", "https://b.example.net/en/", "", "prefix", "en", "scrapy"),
    ("s3", "https://b.example.net/fr/", "", "prefix", "fr", "scrapy"),
    ("s4", "https://c.example.org/", "", "", "en", ""),
    ("s5", " https://c.example.org/x ", "", "bogus", "en", "custom"),
    ("", "https://d.example.org/", "", "domain", "en", "custom"),
]
URLS = [
    (1, "https://Example.org:443/A/b?utm_source=x&b=2&a=1#frag", "https://example.org/A/b?b=2&a=1", None),
    (2, "http://example.org:8080?fbclid=1", "http://example.org:8080/", None),
    (3, "ftp://example.org/x", None, None),
    (4, "https://user:pw@example.org/p;v=1?q=a+b%20c", "https://example.org/p?q=a+b+c", None),
    (5, "https://example.org/x/photo.JPG", "https://example.org/x/photo.JPG", "extension:.jpg"),
    (6, "https://example.org/w/index.php?title=A&action=edit", "https://example.org/w/index.php?title=A&action=edit", "query:action"),
    (7, "https://example.org/wiki/Special:Random", "https://example.org/wiki/Special:Random", "namespace:special"),
    (8, "https://example.org/login/next", "https://example.org/login/next", "junk_path:/login"),
    (9, "https://example.org/wiki/Archivo%3AFoto", "https://example.org/wiki/Archivo%3AFoto", "namespace:archivo%3a"),
    (10, "https://example.org/wiki/Zelda", "https://example.org/wiki/Zelda", None),
]


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def runs(documents: DataFrame) -> DataFrame:
    """Forty runs of four judges over ten needs and three indexes."""
    r = (F.col("doc_id") % 40).alias("run_id")
    ids = documents.select(r).distinct()
    need = F.when(F.col("run_id") % 10 == 0, "").otherwise(F.concat(F.lit("need"), F.col("run_id") % 10))
    return ids.select("run_id", F.concat(F.lit("j"), F.col("run_id") % 4).alias("judge"), need.alias("need"), F.concat(F.lit(" Query "), F.col("run_id") % 5).alias("query"), F.concat(F.lit("i"), F.col("run_id") % 3).alias("index_name"))


def _keys() -> tuple:
    return (F.col("doc_id") % 40).alias("run_id"), (F.floor(F.col("doc_id") / 40) % 30).alias("page_id")


def shown(documents: DataFrame) -> DataFrame:
    """What the runs showed: at most ten pages each."""
    from pyspark.sql import Window

    pages = documents.select(*_keys()).distinct()
    w = Window.partitionBy("run_id").orderBy(F.col("page_id") * 7 % 31, "page_id")
    return pages.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def judgements(labels: DataFrame) -> DataFrame:
    """Grades: 2 for good and clean, 1 for good, else 0; known if toxic."""
    grade = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, 2).otherwise(1)).otherwise(0)
    return labels.select(*_keys(), grade.alias("g"), F.col("toxic").alias("t")).groupBy("run_id", "page_id").agg(F.max("g").alias("relevance"), (F.max("t") == 1).alias("known"))
