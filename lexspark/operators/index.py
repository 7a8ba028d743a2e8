"""TF-IDF inverted index as three DataFrames.

postings(doc_id, term, tf), vocab(term, df, cf, idf), docs(doc_id, length, distinct_terms,
norm). Documents without terms stay in docs with norm 0 and count in N. idf and norms are
doubles.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.analysis import BASIC, Policy, raw_tokens, term_counter
from lexspark.functions.layout import spread
from lexspark.storage import kept

#: Vocabularies of at most so many terms are broadcast to their postings; larger ones meet them in a shuffled join.
BROADCAST_TERMS = 1_000_000


def indexable(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of documents to index; a missing text is an empty document."""
    return pages.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def term_frequencies(docs: DataFrame, policy: Policy = BASIC) -> DataFrame:
    """(doc_id, term, tf). Terms are counted inside their row, so no text and no token is shuffled; doc_id names one row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = term_counter(policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, tf = count(batch.column("tokens"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), terms, tf], ["doc_id", "term", "tf"])

    rows = spread(docs.select("doc_id", "text")).select("doc_id", raw_tokens(F.col("text"), policy).alias("tokens"))
    return rows.mapInArrow(run, f"doc_id {kind}, term string, tf long")


def weight(tf: Column, idf: Column) -> Column:
    return (1 + F.log2(tf)) * idf


def vocabulary(postings: DataFrame, n_docs: Column | int) -> DataFrame:
    """(term, df, cf, idf): partial sums per task, merged by term."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("idf", F.log2(n / F.col("df")))


def with_idf(postings: DataFrame, vocab: DataFrame, n_terms: int) -> DataFrame:
    """Postings with their term's idf. A large vocabulary is joined by shuffle, where adaptive execution splits a very common term."""
    idf = vocab.select("term", "idf")
    return postings.join(F.broadcast(idf) if n_terms <= BROADCAST_TERMS else idf, "term")


def document_table(docs: DataFrame, postings: DataFrame, vocab: DataFrame, n_terms: int) -> DataFrame:
    """(doc_id, length, distinct_terms, norm) of every document."""
    w = weight(F.col("tf"), F.col("idf"))
    sums = with_idf(postings, vocab, n_terms).groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count("*").alias("distinct_terms"), F.sqrt(F.sum(w * w)).alias("norm"))
    zero = {"length": 0, "distinct_terms": 0, "norm": 0.0}
    return docs.select("doc_id").join(sums, "doc_id", "left").fillna(zero)


@dataclass
class Index:
    """An index and what it was built with. A saved one has in its postings also ``unit``, the weight over the document's norm."""

    policy: Policy
    n_docs: int
    postings: DataFrame
    vocab: DataFrame
    docs: DataFrame
    n_terms: int
    held: tuple[DataFrame, ...] = field(default=(), repr=False)

    def close(self) -> None:
        """Free what building the index held in executor storage."""
        for table in self.held:
            table.unpersist()

    def save(self, path: str, buckets: int = 32) -> None:
        """Parquet tables; postings and vocabulary are sorted by term inside range partitions, so that term and prefix filters prune row groups."""
        started = time.perf_counter()
        norm = self.docs.select("doc_id", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"))
        weighted = with_idf(self.postings.select("doc_id", "term", "tf"), self.vocab, self.n_terms).join(norm, "doc_id")
        weighted = weighted.select("doc_id", "term", "tf", (weight(F.col("tf"), F.col("idf")) / F.col("norm")).alias("unit"))
        weighted.repartitionByRange(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.vocab.repartitionByRange(max(1, buckets // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocab")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        spark = self.docs.sparkSession
        meta = [(self.policy.to_json(), self.n_docs, self.n_terms, self.policy.flags(), time.perf_counter() - started)]
        spark.createDataFrame(meta, "policy string, n_docs long, n_terms long, flags int, seconds double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """An index that save() wrote; queries are analysed by the policy stored with it."""
        meta = spark.read.parquet(f"{path}/meta").first()
        postings, vocab, docs = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocab", "docs"))
        return Index(Policy.from_json(meta["policy"]), meta["n_docs"], postings, vocab, docs, meta["n_terms"])


def build(docs: DataFrame, policy: Policy = BASIC, keep: bool = True) -> Index:
    """Index of docs (doc_id, text). keep: hold postings and vocabulary in executor storage until close(), as three tables read them."""
    docs = indexable(docs)
    postings = term_frequencies(docs, policy)
    if keep:
        postings = postings.persist()
    n = docs.count()
    vocab = vocabulary(postings, n)
    if keep:
        vocab = vocab.persist()
    n_terms = vocab.count()
    return Index(policy, n, postings, vocab, document_table(docs, postings, vocab, n_terms), n_terms, (postings, vocab) if keep else ())


def folder_bytes(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def build_report(docs: DataFrame, path: str, policy: Policy = BASIC) -> DataFrame:
    """Build and save an index and tell about it in one row: counts, sizes in bytes by table, their share of the text, seconds by step, MiB of text a second."""
    spark = docs.sparkSession
    begun = time.perf_counter()
    index = build(docs, policy)
    counted = time.perf_counter()
    index.save(path)
    saved = time.perf_counter()
    index.close()
    v = index.vocab.agg(F.sum("cf").alias("tokens"), F.sum("df").alias("postings")).first()
    d = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.count_if(F.col("text").isNull()).alias("missing")).first()
    sizes = {t: folder_bytes(spark, f"{path}/{t}") for t in ("postings", "vocab", "docs")}
    total, text, n = sum(sizes.values()), d["bytes"] or 0, v["postings"] or 0
    row = {
        "policy": policy.name,
        "flags": policy.flags(),
        "docs": index.n_docs,
        "missing": d["missing"],
        "terms": index.n_terms,
        "tokens": v["tokens"] or 0,
        "postings": n,
        "text_bytes": text,
        "index_bytes": total,
        "postings_bytes": sizes["postings"],
        "vocab_bytes": sizes["vocab"],
        "docs_bytes": sizes["docs"],
        "index_share": total / text if text else None,
        "bytes_per_posting": sizes["postings"] / n if n else None,
        "length_mean": (v["tokens"] or 0) / index.n_docs if index.n_docs else 0.0,
        "seconds_count": counted - begun,
        "seconds_save": saved - counted,
        "mib_per_second": text / 2**20 / (saved - begun),
    }
    kinds = {str: "string", int: "long", float: "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in row.items()))


def plot_data(reports: DataFrame) -> DataFrame:
    """(policy, measure, value) of build reports: index size, seconds and vocabulary, ready to plot."""
    measures = {"index_mib": F.col("index_bytes") / 2**20, "seconds": F.col("seconds_count") + F.col("seconds_save"), "terms": F.col("terms").cast("double")}
    return reports.select("policy", F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()))))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc): dense numbers from 0 in the order of doc_id: ranked inside range partitions, whose sizes (one number each) are summed before them."""
    ranged = docs.select("doc_id").repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id())
    ranged = kept(ranged, "ranged")
    sizes = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(sizes), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("doc_id")
    return ranged.withColumn("_n", F.row_number().over(inside) - 1).join(F.broadcast(before), "_part").select("doc_id", (F.col("_n") + F.col("_before")).alias("doc"))


def statistics(index: Index) -> DataFrame:
    """One row: N, V, tokens, postings, hapaxes and their share, median and 1-counts of df, lengths, empty documents."""
    v = index.vocab.agg(
        F.count("*").alias("terms"),
        F.sum("cf").alias("tokens"),
        F.sum("df").alias("postings"),
        F.count_if(F.col("cf") == 1).alias("hapax"),
        F.percentile("df", F.lit(0.5)).alias("df_median"),
        F.count_if(F.col("df") == 1).alias("df_one"),
    ).withColumn("hapax_share", F.round(F.col("hapax") / F.col("terms"), 9))
    d = index.docs.agg(
        F.count("*").alias("docs"),
        F.round(F.avg("length"), 9).alias("length_mean"),
        F.percentile("length", F.lit(0.5)).alias("length_median"),
        F.max("length").alias("length_max"),
        F.count_if(F.col("length") == 0).alias("empty_docs"),
    )
    return v.crossJoin(d)  # one row each


def varbyte_size(n: Column) -> Column:
    """Bytes of a number in 7-bit groups."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + (n >= 2 ** (7 * k)).cast("int")
    return size


def posting_bytes(postings: DataFrame) -> DataFrame:
    """(term, bytes): each posting's gap to the one before it, doubled (the low bit tells tf = 1), then the tf above 1, in varbyte code.

    Gaps are between positions in the order of doc_id. The window is by term: a very common
    term is one sorted run, as it is one list in an index file.
    """
    w = Window.partitionBy("term").orderBy("doc_id")
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.lit(0))
    code = gap * 2 + (F.col("tf") == 1).cast("int")
    size = varbyte_size(code) + F.when(F.col("tf") > 1, varbyte_size(F.col("tf"))).otherwise(0)
    return postings.select("term", size.alias("b")).groupBy("term").agg(F.sum("b").alias("bytes"))


def vocabulary_status(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, status, x, y) of two vocabularies: equal, different, only_a or only_b, with their (df, cf)."""
    left = a.select("term", F.struct("df", "cf").alias("x"))
    right = b.select("term", F.struct("df", "cf").alias("y"))
    status = F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b").when(F.col("x") == F.col("y"), "equal").otherwise("different")
    return left.join(right, "term", "full").select("term", status.alias("status"), "x", "y")


def compare_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(status, terms): how many terms are equal, different, only in one."""
    return vocabulary_status(a, b).groupBy("status").agg(F.count("*").alias("terms"))


def vocabulary_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, status) of the terms of a that b lacks, and the other way round."""
    return vocabulary_status(a, b).where("status IN ('only_a', 'only_b')").select("term", "status")


def dump(vocab: DataFrame) -> DataFrame:
    """term, df, cf in the byte order of terms."""
    return vocab.select("term", "df", "cf").orderBy("term")


def top_terms(vocab: DataFrame, n: int = 40) -> DataFrame:
    return vocab.orderBy(F.desc("df"), "term").limit(n)


def term_report(index: Index, term: str, postings: int = 10) -> DataFrame:
    """The vocabulary row of a term and its first postings."""
    first = index.postings.where(F.col("term") == term).orderBy("doc_id").limit(postings)
    return index.vocab.where(F.col("term") == term).join(first.drop("term"), how="left", on=F.lit(True))


def document_report(index: Index, doc_id: int) -> DataFrame:
    """A document's row with its terms by weight."""
    terms = index.postings.where(F.col("doc_id") == doc_id).join(index.vocab, "term")
    return terms.select("doc_id", "term", "tf", "df", weight(F.col("tf"), F.col("idf")).alias("weight")).orderBy(F.desc("weight"), "term")
