"""Exports: metadata, frequent words, vocabulary dumps, reports, evaluation tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.corpus import ranked, report_parts, word_frequencies
from lexspark.operators.evaluation import RUN_COLUMNS


def metadata_csv(pages: DataFrame, path: str) -> None:
    pages.drop("text").write.mode("overwrite").option("compression", "gzip").csv(path, header=True)


def words_csv(ranked: DataFrame, path: str) -> None:
    ranked.select("rank", "word", "freq").orderBy("rank").coalesce(1).write.mode("overwrite").csv(path, header=True)


def vocabulary_tsv(vocab: DataFrame, path: str) -> None:
    """term, df and cf, in the byte order of terms over all part files."""
    vocab.select("term", "df", "cf").orderBy("term").write.mode("overwrite").option("sep", "\t").csv(path)


def read_word_list(lines: DataFrame) -> DataFrame:
    """(word, freq) from lines ``word => freq``."""
    at = F.regexp_extract("value", r"^(.*) => (\d+)\s*$", 2)
    return lines.select(F.regexp_extract("value", r"^(.*) => (\d+)\s*$", 1).alias("word"), at.try_cast("long").alias("freq")).where("freq IS NOT NULL")


def evaluation_json(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table's rows as JSON lines, ready to write as text."""
    return {name: df.select(F.to_json(F.struct(*df.columns)).alias("value")) for name, df in tables.items()}


def runs_csv(table: DataFrame, path: str) -> None:
    """The table of runs (evaluation.run_table) with the fixed columns in their order."""
    table.select(*RUN_COLUMNS).write.mode("overwrite").csv(path, header=True)


def corpus_report(docs: DataFrame, path: str, most_domains: int = 20, most_words: int = 50, ranked_words: int = 1000) -> DataFrame:
    """Write stats (JSON lines and Markdown) and the ranked words (CSV) of docs (text, source, language, domain) below path; return (part, key, docs, words, bytes).

    Parts: all, source, language, domain (by bytes), word and plain_word (their count under words).
    """
    whole = report_parts(docs, most_domains, most_words)
    words_csv(ranked(word_frequencies(docs), ranked_words), f"{path}/words")
    whole.write.mode("overwrite").json(f"{path}/stats")
    parts = [(p, report_table(whole.where(F.col("part") == p).drop("part").orderBy(F.desc("bytes"), F.desc("words"), "key"), 1000)) for p in ("all", "source", "language", "domain", "word", "plain_word")]
    text = "\n\n".join(f"## {p}\n\n{t}" for p, t in parts)
    docs.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    return whole


def report_json(totals: DataFrame) -> str:
    """A one-row table as a JSON object."""
    row = totals.first()
    return json.dumps(row.asDict() if row else {}, sort_keys=True, default=str)


def report_table(df: DataFrame, most: int = 50) -> str:
    """A few rows as a Markdown table."""
    rows = df.limit(most).collect()
    lines = [df.columns, ["---"] * len(df.columns), *([str(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
