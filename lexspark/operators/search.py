"""Ranked retrieval over an index: query language, cosine scores, filters, feedback.

A query is parsed on the driver (it is a line of text); everything that touches documents
is a plan over postings.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.analysis import Policy, analyze, let
from lexspark.functions.text import edits, escape_html, repair_encoding
from lexspark.functions.urls import host
from lexspark.operators.index import Index, weight

#: Fields of a query, signs of a clause, least letters before a prefix's star, terms a prefix may stand for.
FIELDS = ("site", "idioma", "fuente")
SIGNS = "+-"
PREFIX_LETTERS = 2
MOST_PREFIX_TERMS = 50
PAGE_SIZE = 10


class Clause(NamedTuple):
    """One part of a query: kind is plain, word, phrase, prefix or a field."""

    kind: str
    sign: str
    text: str


def clauses(text: str) -> Iterator[Clause]:
    """The parts of a query between white space. Plain words in a row are one part; what is glued to a closing quote is passed over."""
    run: list[str] = []
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = next((i for i in range(at, len(text)) if text[i].isspace()), len(text))
        sign = text[at] if text[at] in SIGNS and at + 1 < end else ""
        body = text[at + len(sign) : end]
        name, colon, value = body.partition(":")
        shut = text.find('"', at + len(sign) + 1) if body.startswith('"') else -1
        if colon and name in FIELDS and value:
            found = Clause(name, sign, value)
        elif shut > at + len(sign) + 1:
            found = Clause("phrase", sign, text[at + len(sign) + 1 : shut])
            end = next((i for i in range(shut, len(text)) if text[i].isspace()), len(text))
        elif body.endswith("*") and len(body.rstrip("*")) >= PREFIX_LETTERS:
            found = Clause("prefix", sign, body.rstrip("*"))
        elif sign:
            found = Clause("word", sign, body)
        else:
            found = None
            run.append(body)
        if found and run:
            yield Clause("plain", "", " ".join(run))
            run = []
        if found:
            yield found
        at = end
    if run:
        yield Clause("plain", "", " ".join(run))


@dataclass
class Query:
    """What a query asks: terms that score (repeated as asked), that must be there, that must not, in a row; and values by field, excluded sites under ``-site``."""

    scored: list[str] = field(default_factory=list)
    must: list[str] = field(default_factory=list)
    never: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    roots: list[Clause] = field(default_factory=list)
    where: dict[str, list[str]] = field(default_factory=dict)


#: What the terms of a clause are added to, by kind and sign. A phrase of one term counts as a word.
EFFECTS = {
    ("plain", ""): ("scored",),
    ("word", "+"): ("scored", "must"),
    ("word", "-"): ("never",),
    ("word", ""): ("scored",),
    ("phrase", "+"): ("scored", "must", "rows"),
    ("phrase", ""): ("scored", "must", "rows"),
    ("phrase", "-"): ("never",),
}


def analyze_strings(spark, texts: list[str], policy: Policy) -> list[list[str]]:
    """Terms of a few short strings, by the same expressions that analyse documents."""
    if not texts:
        return []
    listed = ", ".join(f"({i}, X'{t.encode().hex()}')" for i, t in enumerate(texts))
    rows = spark.sql(f"SELECT i, decode(b, 'UTF-8') AS text FROM VALUES {listed} AS t(i, b)")  # a local relation: built-in expressions on it need no job
    found = {r["i"]: list(r["terms"]) for r in rows.select("i", analyze(F.col("text"), policy).alias("terms")).collect()}
    return [found[i] for i in range(len(texts))]


def parse(spark, text: str, policy: Policy) -> Query:
    """A query with its words analysed as the index's documents were. Of several languages or sources the last counts."""
    query, parts = Query(), list(clauses(text))
    worded = [c for c in parts if (c.kind, c.sign) in EFFECTS]
    for clause, terms in zip(worded, analyze_strings(spark, [c.text for c in worded], policy), strict=True):
        kind = "word" if clause.kind == "phrase" and len(terms) < 2 else clause.kind
        for target in EFFECTS[kind, clause.sign]:
            if target == "rows":
                query.rows.append(terms)
            else:
                getattr(query, target).extend(terms)
    for clause in parts:
        if clause.kind in FIELDS:
            values = query.where.setdefault("-site" if (clause.kind, clause.sign) == ("site", "-") else clause.kind, [])
            values[:] = [*(values if clause.kind == "site" else []), clause.text.lower()]
    roots = [c for c in parts if c.kind == "prefix"]
    plain = Policy(fold=policy.fold, lower=policy.lower)
    query.roots = [c._replace(text=t[0]) for c, t in zip(roots, analyze_strings(spark, [c.text for c in roots], plain), strict=True) if len(t) == 1]
    return query


def expand_prefix(vocab: DataFrame, prefix: str, most: int = MOST_PREFIX_TERMS) -> DataFrame:
    """At most ``most`` terms that begin so, most documents first. The filter reaches the Parquet scan."""
    return vocab.where(F.startswith("term", F.lit(prefix))).orderBy(F.desc("df"), "term").limit(most).select("term")


def resolve(index: Index, query: Query) -> Query:
    """The query with its prefixes expanded."""
    for clause in query.roots:
        found = [r["term"] for r in expand_prefix(index.vocab, clause.text).collect()]  # at most MOST_PREFIX_TERMS
        (query.never if clause.sign == "-" else query.scored).extend(found)
    return query


def query_weights(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, term, w, query_norm) of queries (query_id, term, one row an occurrence); unknown terms are dropped."""
    counts = queries.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    found = counts.join(vocab.select("term", "idf"), "term").withColumn("w", weight(F.col("qtf"), F.col("idf")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return found.withColumn("query_norm", F.when(norm == 0, 1.0).otherwise(norm)).select("query_id", "term", "idf", "w", "query_norm")


def cosine(index: Index, weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all documents with a term of positive weight."""
    terms = weights.where("w > 0")
    if "unit" in index.postings.columns:  # a saved index
        hits = index.postings.join(terms, "term").groupBy("query_id", "doc_id")
        return hits.agg(F.round(F.sum(F.col("w") / F.col("query_norm") * F.col("unit")), 9).alias("score"))
    hits = index.postings.join(terms, "term")
    part = F.sum(F.col("w") * weight(F.col("tf"), F.col("idf"))).alias("dot")
    dots = hits.groupBy("query_id", "doc_id").agg(part, F.first("query_norm").alias("query_norm"))
    joined = dots.join(index.docs.select("doc_id", "norm"), "doc_id")
    score = F.col("dot") / F.col("query_norm") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return joined.select("query_id", "doc_id", F.round(score, 9).alias("score"))


def top(scores: DataFrame, k: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """The k best documents of each query, ties by doc_id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def search_batch(index: Index, queries: DataFrame, k: int = PAGE_SIZE) -> DataFrame:
    """(query_id, rank, doc_id, score) of plain queries (query_id, text)."""
    terms = queries.select("query_id", F.explode(analyze(F.col("text"), index.policy)).alias("term"))
    return top(cosine(index, query_weights(terms, index.vocab)), k).select("query_id", "rank", "doc_id", "score")


def passes(meta: DataFrame, where: dict[str, list[str]]) -> DataFrame:
    """doc_ids of meta (doc_id, site, language, source) that a query's fields let through."""
    under = lambda names: F.exists(F.array(*map(F.lit, names)), lambda s: (F.col("site") == s) | F.endswith(F.col("site"), F.concat(F.lit("."), s)))
    tests = {"site": under, "-site": lambda names: ~under(names), "idioma": lambda v: F.col("language").isin(v), "fuente": lambda v: F.col("source").isin(v)}
    for name, values in where.items():
        meta = meta.where(tests[name](values))
    return meta.select("doc_id")


def holds_phrase(terms: str, phrase: list[str]):
    """Whether an array column has the phrase's terms in a row."""
    n = len(phrase)
    wanted = F.array(*map(F.lit, phrase))

    def within(array):
        places = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: F.slice(array, i, n) == wanted)

    return let(F.col(terms), within)  # the filter moves below the analysis, which must not run once a place


def known_terms(vocab: DataFrame, terms) -> dict[str, float]:
    """idf of those of a query's terms that the vocabulary has; their filter reaches the scan."""
    listed = sorted(set(terms))
    return {r["term"]: r["idf"] for r in vocab.where(F.col("term").isin(listed)).select("term", "idf").collect()} if listed else {}


def term_weights(index: Index, query: Query, extra: dict[str, float]) -> tuple[dict[str, float], float]:
    """Weights of a query's terms, and their norm. extra adds to them (relevance feedback)."""
    idf = known_terms(index.vocab, [*query.scored, *extra])
    weights = {t: (1 + math.log2(n)) * idf[t] for t, n in Counter(query.scored).items() if t in idf}
    for t, more in extra.items():
        if t in idf:
            weights[t] = weights.get(t, 0.0) + more
    return weights, math.sqrt(sum(w * w for w in weights.values())) or 1.0


def scored(index: Index, query: Query, weights: dict[str, float], norm: float) -> DataFrame:
    """(doc_id, score) of documents with a term of positive weight, all terms that must be there and none that must not: one pass over the query's postings."""
    used = {t: w for t, w in weights.items() if w > 0}
    must, never = sorted(set(query.must)), sorted(set(query.never))
    rows = index.postings.where(F.col("term").isin(sorted({*used, *must, *never})))
    if "unit" not in index.postings.columns:  # not a saved index
        norms = index.docs.select("doc_id", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"))
        rows = rows.join(index.vocab.select("term", "idf"), "term").join(norms, "doc_id").withColumn("unit", weight(F.col("tf"), F.col("idf")) / F.col("norm"))
    w = F.create_map(*(F.lit(x) for t, v in used.items() for x in (t, v / norm)))[F.col("term")] if used else F.lit(None).cast("double")
    out = rows.groupBy("doc_id").agg(F.sum(w * F.col("unit")).alias("score"), F.count_if(F.col("term").isin(must)).alias("have"), F.count_if(F.col("term").isin(never)).alias("bad"))
    return out.where((F.col("have") == len(must)) & (F.col("bad") == 0) & F.col("score").isNotNull()).select("doc_id", F.round("score", 9).alias("score"))


def matches(index: Index, query: Query, weights: dict[str, float], norm: float, documents: DataFrame | None, meta: DataFrame | None) -> DataFrame:
    """(doc_id, score) of all that a query finds. A query of fields only lists what they let through, with score 0."""
    if weights:
        out = scored(index, query, weights, norm)
    elif query.where and meta is not None and not query.scored:
        out = passes(meta, query.where).select("doc_id", F.lit(0.0).alias("score"))
        if query.never:
            out = out.join(index.postings.where(F.col("term").isin(sorted(set(query.never)))).select("doc_id"), "doc_id", "left_anti")
    else:
        out = index.docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    if query.where and meta is not None and weights:
        out = out.join(passes(meta, query.where), "doc_id", "left_semi")
    if query.rows and documents is not None:  # only what the terms let through is read again
        near = documents.join(out.select("doc_id"), "doc_id", "left_semi").select("doc_id", analyze(F.col("text"), index.policy).alias("terms"))
        for row in query.rows:
            near = near.where(holds_phrase("terms", row))
        out = out.join(near.select("doc_id"), "doc_id", "left_semi")
    return out


def best(found: DataFrame, k: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """(rank, doc_id, score) of one page of (doc_id, score): only offset + k rows are ranked."""
    first = found.orderBy(F.desc("score"), "doc_id").limit(offset + k)
    return first.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score").where(F.col("rank") > offset)


def search(index: Index, text: str, documents: DataFrame | None = None, meta: DataFrame | None = None, k: int = PAGE_SIZE, offset: int = 0, extra: dict[str, float] | None = None) -> DataFrame:
    """(rank, doc_id, score) of one query in the query language.

    documents (doc_id, text) are needed for phrases, meta (doc_id, site, language, source) for
    fields. extra adds to term weights (relevance feedback).
    """
    query = resolve(index, parse(index.docs.sparkSession, text, index.policy))
    return best(matches(index, query, *term_weights(index, query, extra or {}), documents, meta), k, offset)


@dataclass
class Answer:
    """One page of results and what is told beside them. ``results`` has rank, doc_id, score, title, url, domain, language and snippet."""

    results: DataFrame
    total: int
    page: int
    pages: int
    ms: float
    unknown: list[str]
    suggestion: str | None
    notice: str | None


NO_FEEDBACK = "no relevant judgement for this query yet: plain search"


def answer(index: Index, text: str, documents: DataFrame, page: int = 1, feedback: tuple[list[int], list[int]] | None = None, size: int = PAGE_SIZE) -> Answer:
    """A page of results over documents (doc_id, url, title, text, language, source).

    feedback: doc_ids judged relevant and not relevant; without a relevant one the search is
    plain and says so. A correction is offered where a term is unknown or nothing is found.
    """
    begun = time.perf_counter()
    spark = index.docs.sparkSession
    query = resolve(index, parse(spark, text, index.policy))
    notice = NO_FEEDBACK if feedback is not None and not feedback[0] else None
    extra = feedback_weights(index, query, *feedback) if feedback is not None and feedback[0] else {}
    weights, norm = term_weights(index, query, extra)
    meta = documents.select("doc_id", host(F.col("url")).alias("site"), F.lower("language").alias("language"), F.lower("source").alias("source"))
    found = matches(index, query, weights, norm, documents, meta)
    total = found.count()
    page = max(1, page)
    ranks = best(found, size, (page - 1) * size).collect()  # at most ``size``
    shown = spark.createDataFrame([tuple(r) for r in ranks], "rank int, doc_id long, score double")
    own = documents.where(F.col("doc_id").isin([r["doc_id"] for r in ranks])) if ranks else documents.where(F.lit(False))
    texts = snippets(own.select("doc_id", "text"), sorted({*weights, *query.must}), index.policy)
    title = repair_encoding(F.trim(F.coalesce("title", F.lit(""))))
    rows = own.select("doc_id", F.when(title == "", F.col("url")).otherwise(title).alias("title"), "url", F.lower(F.coalesce(host(F.col("url")), F.lit(""))).alias("domain"), F.coalesce("language", F.lit("")).alias("language"))
    results = shown.join(rows, "doc_id", "left").join(texts, "doc_id", "left").select("rank", "doc_id", "score", "title", "url", "domain", "language", F.coalesce("snippet", F.lit("")).alias("snippet"))
    unknown = sorted({t for t in query.scored if t not in known_terms(index.vocab, query.scored)}) if query.scored and len(weights) < len(set(query.scored) | set(extra)) else []
    suggestion = correction(index, text) if unknown or total == 0 else None
    return Answer(results, total, page, -(-total // size), 1000 * (time.perf_counter() - begun), unknown, suggestion, notice)


def document_vectors(index: Index, ids: list[int]) -> DataFrame:
    """(doc_id, term, w) of unit length."""
    rows = index.postings.where(F.col("doc_id").isin(ids)).join(index.vocab.select("term", "idf"), "term").join(index.docs.select("doc_id", "norm"), "doc_id")
    return rows.select("doc_id", "term", (weight(F.col("tf"), F.col("idf")) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("w"))


def feedback_terms(index: Index, query: Query, relevant: list[int], others: list[int], beta: float = 0.75, gamma: float = 0.15, new_terms: int = 10) -> DataFrame:
    """(term, w, known): what relevance feedback adds to the query's terms, and its best new terms."""
    mine = sorted(set(query.scored))
    share = F.when(F.col("doc_id").isin(relevant), F.lit(beta / max(1, len(relevant)))).otherwise(F.lit(-gamma / max(1, len(others))))
    total = document_vectors(index, [*relevant, *others]).groupBy("term").agg(F.sum(F.col("w") * share).alias("w"))
    total = total.withColumn("known", F.col("term").isin(mine))
    new = total.where("NOT known AND w > 0").orderBy(F.desc(F.round("w", 12)), "term").limit(new_terms)
    return total.where("known AND w <> 0").unionByName(new)


def feedback_weights(index: Index, query: Query, relevant: list[int], others: list[int], **options) -> dict[str, float]:
    """What feedback adds to term weights, scaled by the norm of the query."""
    _, norm = term_weights(index, query, {})
    return {r["term"]: r["w"] * norm for r in feedback_terms(index, query, relevant, others, **options).collect()}  # the query's terms and new_terms more


def rocchio(index: Index, text: str, relevant: list[int], others: list[int], k: int = PAGE_SIZE, **options) -> DataFrame:
    """Search with feedback weights."""
    query = parse(index.docs.sparkSession, text, index.policy)
    weights = term_weights(index, query, feedback_weights(index, query, relevant, others, **options))
    return best(matches(index, query, *weights, None, None), k)


def classic(index: Index, queries: DataFrame, k: int = PAGE_SIZE) -> DataFrame:
    """A second ranking: sqrt(tf) * idf^2 / sqrt(length), idf = 1 + ln(N / (df + 1)); any term matches."""
    terms = queries.select("query_id", F.explode(analyze(F.col("text"), index.policy)).alias("term"))
    idf = 1 + F.log(F.lit(index.n_docs) / (F.col("df") + 1))
    counts = terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(index.vocab.select("term", idf.alias("idf1")), "term")
    hits = index.postings.join(counts, "term")
    dots = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.sqrt("tf") * F.col("idf1") * F.col("idf1")).alias("dot"))
    scores = dots.join(index.docs.select("doc_id", "length"), "doc_id").select("query_id", "doc_id", F.round(F.col("dot") / F.sqrt("length"), 9).alias("score"))
    return top(scores, k).select("query_id", "rank", "doc_id", "score")


def suggest(words: DataFrame, vocab: DataFrame, policy: Policy) -> DataFrame:
    """(word, suggestion, df): for words the vocabulary lacks, the string one edit away whose single term most documents have; ties by string."""
    asked = words.select("word", F.lower("word").alias("low"), analyze(F.lower("word"), policy).alias("terms")).where(F.size("terms") > 0)
    terms = asked.select("word", "low", F.explode("terms").alias("term"))
    missing = terms.join(vocab.select("term"), "term", "left_anti").select("word", "low").distinct()
    tried = missing.select("word", F.explode(edits(F.col("low"))).alias("candidate")).select("word", "candidate", analyze(F.col("candidate"), policy).alias("t")).where(F.size("t") == 1)
    found = tried.select("word", "candidate", F.get("t", F.lit(0)).alias("term")).join(vocab.select("term", "df"), "term")
    best = Window.partitionBy("word").orderBy(F.desc("df"), "candidate")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").select("word", F.col("candidate").alias("suggestion"), "df")


def correction(index: Index, text: str) -> str | None:
    """The query with each unknown word replaced by its suggestion; None if nothing changes. Signed words and words with a colon stay."""
    words = text.split()
    asked = sorted({w for w in words if ":" not in w and w[0] not in SIGNS})
    if not asked:
        return None
    found = suggest(index.docs.sparkSession.createDataFrame([(w,) for w in asked], "word string"), index.vocab, index.policy)
    better = {r["word"]: r["suggestion"] for r in found.collect()}  # at most one a word of the query
    return " ".join(better.get(w, w) for w in words) if better else None


def snippets(documents: DataFrame, terms: list[str], policy: Policy, width: int = 32, most_chars: int = 200_000) -> DataFrame:
    """(doc_id, snippet) of result documents: the first window of ``width`` words with most hits, hits marked."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, most_chars)
    words = F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", " "), " "), lambda w: w != "")
    wanted = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    rows = documents.select("doc_id", words.alias("words")).withColumn("n", F.size("words"))
    places = rows.select("doc_id", "n", F.posexplode("words").alias("pos", "word")).withColumn("hit", F.arrays_overlap(analyze(F.col("word"), policy), wanted).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = F.when(F.col("n") >= width, F.sum("hit").over(w.rowsBetween(0, width - 1))).otherwise(F.col("hit"))
    counted = places.withColumn("count", F.when((F.col("n") < width) | (F.col("pos") <= F.col("n") - width), ahead))
    start = counted.groupBy("doc_id").agg(F.max("n").alias("n"), F.min_by("pos", F.struct(-F.coalesce("count", F.lit(-1)), F.col("pos"))).alias("start"), F.max("hit").alias("any"))
    start = start.withColumn("start", F.when(F.col("any") == 1, F.col("start")).otherwise(0))
    shown = places.join(start.drop("n"), "doc_id").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + width))
    marked = F.when(F.col("hit") == 1, F.concat(F.lit("<mark>"), escape_html(F.col("word")), F.lit("</mark>"))).otherwise(escape_html(F.col("word")))
    joined = shown.groupBy("doc_id").agg(F.max("n").alias("n"), F.max("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", marked.alias("m")))), lambda x: x["m"]), " ").alias("body"))
    text = F.concat(F.when(F.col("start") > 0, "… ").otherwise(""), F.col("body"), F.when(F.col("start") + width < F.col("n"), " …").otherwise(""))
    return joined.select("doc_id", text.alias("snippet"))
