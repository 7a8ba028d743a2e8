"""A training corpus from the documents table: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir); run() writes each result as Parquet to the shared
folder and reads it back as the next stage's docs. All but the last return the columns of
the documents they were given.

Defined results: rows without doc_id pass the stages that compare by doc_id unchanged; a
null text has no language and goes in the first stage; of rows with one doc_id that are
equal, one stays after near-duplicate removal; of near duplicates of equal standing the least
doc_id stays. Extra columns, whatever their names, pass all stages but the last. An empty table
gives an empty result. Texts of any length are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.decontam import decontaminate
from lexspark.llm.langid import document_languages
from lexspark.llm.neardup import near_duplicates
from lexspark.llm.packing import pack
from lexspark.llm.substring import substring_dedup
from lexspark.storage import drop, kept

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
WINDOW_WORDS = 20
SEQUENCE_TOKENS = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: those without letters, or unlike every language of the corpus."""
    rejected = document_languages(docs).where(~F.col("accepted")).select(F.col("doc_id").alias("_lexspark_id"), F.col("k").alias("_lexspark_k")).distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_lexspark_id")) & (F.xxhash64("text") == F.col("_lexspark_k")), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each group of near duplicates."""
    found = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of WINDOW_WORDS words or more that stand earlier in the corpus; documents left without words go."""
    others = {c: f"_lexspark_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = substring_dedup(docs.select("doc_id", "text", *(F.col(c).alias(a) for c, a in others.items())), WINDOW_WORDS, with_text=True, carry=list(others.values()))

    def column(c: str):
        if c == "n_chars":  # follows the text
            return F.when(F.col("n_removed") == 0, F.col(others[c])).otherwise(F.length("kept_text").cast(docs.schema[c].dataType)).alias(c)
        return F.col("kept_text" if c == "text" else others.get(c, c)).alias(c)

    return cut.where("n_removed = 0 OR kept_text <> ''").select(*map(column, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(docs, benchmark, min_items=1).where("contaminated").select(F.col("doc_id").alias("_lexspark_id")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_lexspark_id")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack(docs, SEQUENCE_TOKENS)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express the trained language model, the tokeniser or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs
