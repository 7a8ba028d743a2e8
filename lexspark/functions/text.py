"""Text functions: counts, hashes, language, subject, repair, edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexspark.functions import tables
from lexspark.functions.analysis import let

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def word_count(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with every run of white space as one space."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 256)


def report_words(text: Column) -> Column:
    """Lower-case runs of letters, as the corpus report counts them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), 1)


def detect_language(text: Column) -> Column:
    """en, es or other by the share of their function words among the first words."""
    words = F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, tables.LANGUAGE_CHARS), F.lit(r"([a-zA-ZáéíóúüñÁÉÍÓÚÜÑ']+)"), 1)
    words = F.slice(F.transform(words, lambda w: F.lower(w)), 1, tables.LANGUAGE_WORDS)

    def judge(w: Column) -> Column:
        n = F.size(w)
        en = F.size(F.filter(w, lambda x: x.isin(*tables.ENGLISH))) / F.greatest(n, F.lit(1))
        es = F.size(F.filter(w, lambda x: x.isin(*tables.SPANISH))) / F.greatest(n, F.lit(1))
        told = F.when((en >= tables.LANGUAGE_SHARE) & (en > es), "en").when((es >= tables.LANGUAGE_SHARE) & (es > en), "es").otherwise("other")
        return F.when(n < tables.LANGUAGE_LEAST, "other").otherwise(told)

    return let(words, judge)


def _keyword_words(word: str) -> str:
    out, run = [], ""
    for c in word.lower().replace("_", " ").replace("-", " ") + " ":
        if c.isascii() and (c.isalnum() or (c == "'" and run)):
            run += c
        elif run:
            out.append(run.rstrip("'"))
            run = ""
    return " ".join(out)


def topical_score(text: Column, keywords: list[str] | None = None) -> Column:
    """struct(hits, density): keywords among the words, and phrases in the words joined; density per 1000 words."""
    keys = {_keyword_words(k) for k in (keywords if keywords is not None else tables.TOPIC_WORDS)} - {""}
    single, several = sorted(k for k in keys if " " not in k), sorted(k for k in keys if " " in k)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+(?:'[a-z]+)?)"), 1)
    hits = F.size(F.filter(words, lambda w: w.isin(*single))) if single else F.lit(0)
    joined = F.array_join(words, " ")
    for phrase in several:
        hits = hits + ((F.length(joined) - F.length(F.replace(joined, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")
    density = F.when(F.size(words) > 0, hits / F.size(words) * 1000.0).otherwise(F.lit(0.0))
    return F.struct(hits.cast("int").alias("hits"), density.alias("density"))


def is_topical(score: Column) -> Column:
    return (score["hits"] >= tables.TOPIC_LEAST_HITS) & (score["density"] >= tables.TOPIC_LEAST_DENSITY)


def repair_encoding(text: Column) -> Column:
    """UTF-8 that was read as cp1252 or Latin-1 and still shows it, read again; else the text as it is. Only texts that show it are sent to Python."""
    marked = F.contains(text, F.lit("Ã")) | F.contains(text, F.lit("â€"))
    return F.when(marked, _read_again(F.when(marked, text))).otherwise(text)


@F.pandas_udf(StringType())
def _read_again(texts: pd.Series) -> pd.Series:

    def one(s):
        if not isinstance(s, str) or not ("Ã" in s or "â€" in s):
            return s
        for codec in ("cp1252", "latin-1"):
            try:
                return s.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
        return s

    return texts.map(one)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def edits(word: Column) -> Column:
    """All strings one deletion, transposition, replacement or insertion away (letters a-z and digits)."""
    n = F.length(word)
    letters = F.array(*map(F.lit, LETTERS))
    cuts = F.sequence(F.lit(0), n)
    left = lambda i: F.substring(word, F.lit(1), i)
    right = lambda i: F.substring(word, i + 1, n)
    inner = F.filter(cuts, lambda i: i < n)
    deletes = F.transform(inner, lambda i: F.concat(left(i), right(i + 1)))
    swaps = F.transform(F.filter(cuts, lambda i: i < n - 1), lambda i: F.concat(left(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), right(i + 2)))
    replaces = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1)))))
    inserts = F.flatten(F.transform(cuts, lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(deletes, swaps, replaces, inserts))
