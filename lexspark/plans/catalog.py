"""All queries of the retrieval library by name, over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import html as H
from lexspark.functions import text as X
from lexspark.functions import urls as U
from lexspark.functions.analysis import BASIC, FULL, STOP, Policy, analyze, fold, normalize_dates, normalize_numbers
from lexspark.functions.layout import spread
from lexspark.operators import corpus, evaluation, repository
from lexspark.operators.journal import Journal
from lexspark.operators import index as I
from lexspark.operators import search as S
from lexspark.plans import cases, oracles
from lexspark.sources import crawl_log, exports, fetch, seeds
from lexspark.storage import application_dir
from lexspark.streaming import progress as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOPIC = ["stupid", "trash", "worth-less", "of the"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents")


def meta(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lower("source").alias("site"), F.col("lang").alias("language"), F.col("source"))


def needs(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_saved: dict[tuple[str, str, str], str] = {}


def saved_index(spark, sf, name: str = "documents", id_column: str = "doc_id", text_column: str = "text") -> I.Index:
    """The index of a table, built and saved once an application: queries read it pruned by term."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _saved:
        built = I.build(table(spark, sf, name).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
        path = f"{application_dir(spark)}/index-{uuid.uuid4().hex}"
        built.save(path)
        built.close()
        _saved[key] = path
    return I.Index.load(spark, _saved[key])


def ask(spark, sf, text: str, k: int = 10) -> DataFrame:
    docs = documents(spark, sf)
    return S.search(saved_index(spark, sf), text, docs, meta(docs), k)


def library(spark, sf) -> DataFrame:
    """Documents as a searcher shows them: every third without a title."""
    docs = documents(spark, sf)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".Example.org/"), F.col("doc_id"))
    return docs.select("doc_id", url.alias("url"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" No. "), F.col("doc_id"))).alias("title"), "text", F.col("lang").alias("language"), "source")


# --- index


@query
def index_postings(spark, sf):
    return I.term_frequencies(I.indexable(documents(spark, sf)))


@query
def index_vocab(spark, sf):
    return saved_index(spark, sf).vocab.withColumn("idf", F.round("idf", 9))


@query
def index_docs(spark, sf):
    return saved_index(spark, sf).docs.withColumn("norm", F.round("norm", 6))


@query
def index_stats(spark, sf):
    return I.statistics(saved_index(spark, sf))


@query
def index_varbyte_bytes(spark, sf):
    return I.posting_bytes(I.term_frequencies(I.indexable(documents(spark, sf)))).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("terms"))


@query
def index_vocab_stop(spark, sf):
    return I.vocabulary(I.term_frequencies(I.indexable(documents(spark, sf)), STOP), 1).select("term", "df", "cf")


@query
def index_vocab_stems(spark, sf):
    return I.vocabulary(I.term_frequencies(I.indexable(documents(spark, sf)), FULL), 1).select("term", "df", "cf")


@query
def vocab_compare(spark, sf):
    docs = I.indexable(documents(spark, sf))
    first = I.vocabulary(I.term_frequencies(docs), 1)
    second = corpus.word_frequencies(docs).select(F.col("word").alias("term"), F.col("freq").alias("df"), F.col("freq").alias("cf"))
    return I.compare_vocabularies(first, second)


@query
def vocab_difference(spark, sf):
    docs = I.indexable(documents(spark, sf))
    return I.vocabulary_difference(I.vocabulary(I.term_frequencies(docs), 1), I.vocabulary(I.term_frequencies(docs, STOP), 1))


@query
def index_report(spark, sf):
    report = I.build_report(documents(spark, sf), f"{application_dir(spark)}/index-{uuid.uuid4().hex}")
    return report.select("policy", "docs", "missing", "terms", "tokens", "postings", "text_bytes", F.round("length_mean", 6).alias("length_mean"), ((F.col("index_bytes") == F.col("postings_bytes") + F.col("vocab_bytes") + F.col("docs_bytes")) & (F.col("bytes_per_posting") > 0) & (F.col("index_share") > 0)).alias("sized"))


@query
def index_plots(spark, sf):
    report = I.build_report(documents(spark, sf), f"{application_dir(spark)}/index-{uuid.uuid4().hex}")
    return I.plot_data(report).where("measure = 'terms'")


@query
def doc_numbers(spark, sf):
    return I.numbered(documents(spark, sf).where("doc_id % 3 > 0"))


@query
def top_terms(spark, sf):
    return I.top_terms(I.vocabulary(I.term_frequencies(I.indexable(documents(spark, sf))), 1), 40).select("term", "df", "cf")


@query
def dates_numbers(spark, sf):
    """Order dates in seven spellings, with a price and an ordinal beside them."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.floor("o_totalprice").cast("long").alias("price"))
    day, year = F.dayofmonth("d"), F.year("d")
    month = lambda names: F.element_at(F.array(*map(F.lit, names.split())), F.month("d"))
    spellings = [
        F.concat_ws(" ", month(cases.MONTHS_EN), F.concat(day, F.lit(",")), year),
        F.concat_ws(" ", F.concat(day, F.lit("th")), month(cases.MONTHS_EN), year),
        F.concat_ws(" ", day, F.lit("de"), month(cases.MONTHS_ES), F.lit("de"), year),
        F.concat_ws("-", year, F.month("d"), day),
        F.date_format("d", "yyyy/MM/dd"),
        F.date_format("d", "MM/dd/yyyy"),
        F.concat(F.lit("abr 31, "), F.lit("19999")),
    ]
    text = F.concat_ws(" ", F.lit("on"), F.element_at(F.array(*spellings), (F.col("o_orderkey") % len(spellings) + 1).cast("int")), F.lit("for"), F.format_number("price", 0), F.lit("the"), F.concat(F.col("o_orderkey") % 90 + 1, F.lit("ST")))
    return rows.select("o_orderkey", normalize_numbers(normalize_dates(text)).alias("result"))


def phrases(spark, sf) -> DataFrame:
    """Parts with a phrase of the tables between two words."""
    put = F.element_at(F.array(*(F.lit(x) for x, _, _ in cases.PHRASES)), (F.col("p_partkey") % len(cases.PHRASES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Bought "), put, F.lit(" again")).alias("text"))


@query
def analyze_full(spark, sf):
    return phrases(spark, sf).select("p_partkey", F.array_join(analyze(F.col("text"), FULL), " ").alias("result"))


@query
def analyze_phrases(spark, sf):
    return phrases(spark, sf).select("p_partkey", F.array_join(analyze(F.col("text"), Policy("phrases", names=True, thesaurus=True)), " ").alias("result"))


@query
def fold_letters(spark, sf):
    words = documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("w"))
    return words.select(fold(F.lower("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query
def repair_encoding(spark, sf):
    """Texts with letters beyond ASCII, their UTF-8 read as Latin-1."""
    docs = documents(spark, sf).where("octet_length(text) <> length(text)")
    return docs.select("doc_id", F.md5(X.repair_encoding(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))).alias("result"))


# --- search


@query
def search_cosine(spark, sf):
    return S.search_batch(saved_index(spark, sf), needs(spark, sf))


@query
def search_classic(spark, sf):
    return S.classic(saved_index(spark, sf), needs(spark, sf))


@query
def search_required_excluded(spark, sf):
    return ask(spark, sf, "stupid +trash -worthless")


@query
def search_site_lang(spark, sf):
    return ask(spark, sf, "stupid trash site:src3 site:src5 site:src6 -site:src6 idioma:en")


@query
def search_filter_only(spark, sf):
    return ask(spark, sf, "fuente:src4 idioma:de", k=20)


@query
def search_prefix(spark, sf):
    return ask(spark, sf, "worthl* -stup*")


@query
def search_phrase(spark, sf):
    return ask(spark, sf, '"all rights reserved"', k=20)


@query
def search_unknown_term(spark, sf):
    return ask(spark, sf, "stupid zzzznowhere")


def judged(spark, sf) -> tuple[list[int], list[int]]:
    labels = table(spark, sf, "labels")
    good = [r[0] for r in labels.where("toxic = 1 AND quality = 1").orderBy("doc_id").limit(3).select("doc_id").collect()]
    bad = [r[0] for r in labels.where("quality = 0").orderBy("doc_id").limit(3).select("doc_id").collect()]
    return good, bad


@query
def search_rocchio(spark, sf):
    good, bad = judged(spark, sf)
    return S.rocchio(saved_index(spark, sf), "stupid trash", good, bad).withColumn("score", F.round("score", 7))


@query
def rocchio_terms(spark, sf):
    good, bad = judged(spark, sf)
    index = saved_index(spark, sf)
    return S.feedback_terms(index, S.parse(spark, "stupid trash", index.policy), good, bad).select("term", F.round("w", 9).alias("w"), "known")


@query
def suggest(spark, sf):
    words = cases.inline(spark, [("stupidd",), ("trsah",), ("worthles",), ("thee",), ("stupid",), ("qqqqqqqq",)], "word string")
    return S.suggest(words, saved_index(spark, sf).vocab, BASIC)


@query
def suggest_queries(spark, sf):
    index = saved_index(spark, sf)
    texts = ["stupidd trsah", "the stupid trash", "-stupidd site:trsah worthles", "qqqqqqqq", "Thee +trsah"]
    return spark.createDataFrame([(t, S.correction(index, t)) for t in texts], "text string, suggestion string")


@query
def search_page(spark, sf):
    found = S.answer(saved_index(spark, sf), "stupid trash zzzznowhere", library(spark, sf), page=2)
    return found.results.select("rank", "doc_id", "score", "title", "url", "domain", "language", F.lit(found.total).alias("total"), F.lit(found.pages).alias("pages"), F.lit(" ".join(found.unknown)).alias("unknown"), F.lit(found.suggestion).cast("string").alias("suggestion"), F.lit(found.notice).cast("string").alias("notice"))


@query
def search_page_feedback(spark, sf):
    good, bad = judged(spark, sf)
    found = S.answer(saved_index(spark, sf), "stupid trash", library(spark, sf), feedback=(good, bad))
    return found.results.select("rank", "doc_id", F.round("score", 7).alias("score"))


@query
def search_glued_quotes(spark, sf):
    return ask(spark, sf, 'stupid "trash"worthless "" "+')


@query
def journal_run(spark, sf):
    """A run recorded, judged twice and read back: what was shown, with the grade that counts."""
    book = Journal(spark, f"{application_dir(spark)}/journal-{uuid.uuid4().hex}")
    found = S.answer(saved_index(spark, sf), "stupid trash", library(spark, sf))
    run = book.run("ann", None, "stupid trash", "basico", found)
    shown = [r["page_id"] for r in book.table("shown").orderBy("rank").collect()]
    for place, grade in ((0, 2), (1, 0), (0, 1)):
        book.judge(run, shown[place], grade)
    book.click(book.query("session", "stupid trash", "basico", found), shown[0], 1)
    counts = book.table("queries").agg(F.count("*").alias("queries")).crossJoin(book.table("clicks").agg(F.count("*").alias("clicks")))  # one row each
    marks = book.judgements().select("run_id", "page_id", "relevance")
    return book.table("shown").join(marks, ["run_id", "page_id"], "left").select("rank", "page_id", "score", F.coalesce("relevance", F.lit(-1)).alias("relevance")).crossJoin(counts)


@query
def search_page_site(spark, sf):
    pages = table(spark, sf, "pages")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    sites = pages.select(F.col("page_id").alias("doc_id"), U.domain(F.col("url")).alias("site"), F.lit("x").alias("language"), F.lit("x").alias("source"))
    return S.search(saved_index(spark, sf, "pages", "page_id", "html"), "site:example.org -site:spam-farm.example.org", docs, sites, 20)


@query
def edit_candidates(spark, sf):
    rows = cases.inline(spark, [("ab",), ("x",), ("zelda",)], "word string")
    return rows.select("word", F.size(X.edits(F.col("word"))).alias("candidates"))


@query
def snippet(spark, sf):
    docs = documents(spark, sf)
    return S.snippets(docs.where(F.contains("text", F.lit("All rights reserved"))), ["rights", "reserved"], BASIC)


# --- corpus


@query
def zipf_rank(spark, sf):
    return corpus.ranked(corpus.word_frequencies(documents(spark, sf)), 1000)


@query
def top_words_nostop(spark, sf):
    freq = corpus.word_frequencies(documents(spark, sf))
    return freq.where(~corpus.report_stopword(F.col("word"))).orderBy(F.desc("freq"), "word").limit(50)


@query
def corpus_totals(spark, sf):
    docs = documents(spark, sf)
    return corpus.totals(docs, corpus.word_frequencies(docs))


@query
def corpus_by_source_lang(spark, sf):
    return corpus.grouped(documents(spark, sf), {"source": F.col("source"), "lang": F.col("lang")})


@query
def corpus_by_domain(spark, sf):
    pages = table(spark, sf, "pages").select(U.domain(F.col("url")).alias("domain"), F.octet_length("html").alias("bytes"))
    return corpus.largest(pages, "domain", 15)


@query
def progress_by_source(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    pages = events.select(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"), F.col("user_id").alias("bytes"))
    return corpus.progress(pages, F.lit(now.first()["now"]))


@query
def corpus_report(spark, sf):
    docs = documents(spark, sf).select("text", "source", F.col("lang").alias("language"), F.concat(F.lit("d"), F.col("doc_id") % 30).alias("domain"))
    return exports.corpus_report(docs, f"{application_dir(spark)}/report-{uuid.uuid4().hex}")


@query
def crawled_pages(spark, sf):
    own = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    other = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), "url")
    return corpus.crawled_pages(custom=own, scrapy=other).groupBy("crawler_source").agg(F.count("*").alias("pages"), F.count("url").alias("with_url"), F.sum(F.octet_length("text")).alias("bytes"))


@query
def thin_content(spark, sf):
    return corpus.thin(documents(spark, sf)).select("doc_id", "words")


# --- text


@query
def lang_detect(spark, sf):
    return spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", X.detect_language(F.col("text")).alias("language"))


@query
def topical_score(spark, sf):
    rows = spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", X.topical_score(F.col("text"), TOPIC).alias("s"))
    return rows.select("doc_id", "s.hits", F.round("s.density", 9).alias("density"), X.is_topical(F.col("s")).alias("topical"))


@query
def topical_default(spark, sf):
    """The default keywords, on texts into which they are put."""
    words = ("game", "gameplay", "gamers", "games", "gaming", "gamer", "videojuegos", "video game", "nothing")
    put = F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % len(words) + 1).cast("int"))
    rows = documents(spark, sf).select("doc_id", X.topical_score(F.concat(F.lit("x "), F.repeat(F.concat(put, F.lit(" ")), 6), F.coalesce("lang", F.lit("")))).alias("s"))
    return rows.select("doc_id", "s.hits", X.is_topical(F.col("s")).alias("topical"))


@query
def content_dedup(spark, sf):
    rows = documents(spark, sf).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query
def word_counts(spark, sf):
    return documents(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("words"), F.octet_length("text").alias("bytes"))


# --- URLs and pages


@query
def url_cases(spark, sf):
    rows = cases.inline(spark, cases.URLS, "id int, url string, expected string, reason string")
    return rows.select("id", U.normalize_url(F.col("url")).alias("normalized"), U.denied(F.col("url")).alias("reason"))


@query
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url"), U.canonical_url(F.col("url")).alias("canonical"), U.domain(F.col("url")).alias("domain"))


@query
def url_denied(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.denied(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, "?oldid=7").otherwise(""))).alias("reason"))


@query
def url_domain_port(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain_with_port(F.concat(F.regexp_replace("url", "^(https?://)([^/?#]*)", "$1user@$2:8080"))).alias("domain"))


@query
def url_scope_default(spark, sf):
    """The default keywords in anchors of a topical host."""
    rules = cases.inline(spark, [("ththed.example.org", "topical", [])], "host string, mode string, prefixes array<string>")
    words = ("gaming", "gamer news", "speed-run", "x", "Video Game", "recipes")
    anchor = F.element_at(F.array(*map(F.lit, words)), (F.col("page_id") % len(words) + 1).cast("int"))
    links = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://ththed.example.org/p"), F.col("page_id")).alias("url"), anchor.alias("anchor"), F.lit(False).alias("parent_topical"))
    return U.in_scope(links, rules).select("page_id", "ok", "reason")


@query
def url_host_rules(spark, sf):
    rows = seeds.clean_seeds(cases.inline(spark, cases.SEEDS, ", ".join(f"{c} string" for c in seeds.COLUMNS)))
    return U.host_rules(rows).withColumn("prefixes", F.array_join("prefixes", " "))


@query
def url_scope(spark, sf):
    rules = cases.inline(spark, [("spam-farm.example.org", "domain", []), ("blog.ththan.example.net", "prefix", ["/en/"]), ("ththed.example.org", "topical", [])], "host string, mode string, prefixes array<string>")
    links = table(spark, sf, "pages").select("page_id", "url", F.lit("anchor").alias("anchor"), (F.col("page_id") % 2 == 0).alias("parent_topical"))
    return U.in_scope(links, rules, ["utm_source"]).select("page_id", "ok", "reason")


@query
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query
def html_links(spark, sf):
    rows = spread(table(spark, sf, "pages")).select("page_id", H.extract_links("html", "url").alias("links"))
    return rows.select("page_id", F.posexplode("links").alias("place", "link")).select("page_id", "place", "link.url", "link.anchor")


@query
def html_text(spark, sf):
    rows = spread(table(spark, sf, "pages")).select("page_id", H.extract_page("html", "url").alias("p"))
    return rows.select("page_id", "p.title", F.length("p.text").alias("chars"), X.detect_language(F.col("p.text")).alias("language"))


@query
def fetch_pages(spark, sf):
    def get(url: str) -> dict:  # stands for a network: no page of the table is looked up
        if len(url) % 7 == 0:
            raise TimeoutError(url)
        return {"status_code": 200 if len(url) % 5 else 404, "content_type": "text/html; charset=utf-8", "body": url.encode()}

    return fetch.fetch(table(spark, sf, "pages"), get).select("url", F.coalesce("status_code", F.lit(0)).alias("status_code"), "body", "truncated", "error")


@query
def fetch_cut(spark, sf):
    """Bodies around the most bytes that are kept."""

    def get(url: str) -> dict:
        return {"status_code": 200, "content_type": "text/html", "body": b"x" * (4_999_999 + len(url) % 3)}

    tasks = table(spark, sf, "pages").where("page_id < 12")
    return fetch.fetch(tasks, get).select("url", F.length("body").alias("chars"), "truncated")


@query
def robots(spark, sf):
    rules = cases.inline(spark, [("spam-farm.example.org", "/", False), ("spam-farm.example.org", "/en/", True), ("ththed.example.org", "/en/", False)], "site string, path string, allow boolean")
    urls = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("site"), U.path(F.col("url")).alias("path"))
    return fetch.robots_allowed(urls, rules).select("page_id")


# --- repository and frontier


def arrivals(spark, sf) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("seq"), F.concat(F.lit("u"), F.col("doc_id") % 700).alias("url"), X.content_hash(F.col("text")).alias("content_hash"))


@query
def save_outcomes(spark, sf):
    return repository.save_outcomes(arrivals(spark, sf)).select("seq", "url", "outcome")


@query
def save_outcomes_updates(spark, sf):
    """URLs that change their content often, onto pages that are there."""
    rows = documents(spark, sf).select(F.col("doc_id").alias("seq"), F.concat(F.lit("u"), F.pmod(F.col("doc_id") * 7919, F.lit(151))).alias("url"), F.concat(F.lit("h"), F.pmod(F.col("doc_id") * 104729, F.lit(83))).alias("content_hash"))
    pages = cases.inline(spark, [("u1", "h1"), ("u2", "h2"), ("zz", "h3")], "url string, content_hash string")
    return repository.save_outcomes(rows, pages).select("seq", "outcome")


@query
def known_duplicates(spark, sf):
    docs = documents(spark, sf).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return repository.duplicates(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("doc_id")


@query
def upsert_labels(spark, sf):
    labels = table(spark, sf, "labels")
    rows = labels.where("doc_id % 3 = 0").select("doc_id", F.lit(7).alias("quality"), F.col("toxic"), F.col("doc_id").alias("seq"))
    more = rows.select("doc_id", F.lit(8).alias("quality"), "toxic", (F.col("seq") + 1).alias("seq")).where("doc_id % 2 = 0")
    fresh = rows.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "quality", "toxic", "seq")
    old = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), "toxic", F.lit(0).cast("long").alias("seq"))
    return repository.upsert(old, rows.unionByName(more).unionByName(fresh), ["doc_id"], "seq").select("doc_id", "quality")


@query
def page_decision(spark, sf):
    docs = documents(spark, sf)
    rows = repository.page_decision(docs, F.when(F.col("doc_id") % 2 == 0, "topical").otherwise("domain"), F.col("doc_id") % 3, TOPIC)
    return rows.select("doc_id", "hits", "topical", "reason", "saved")


def tasks(spark, sf) -> DataFrame:
    url = F.concat(F.lit("https://h"), F.col("o_custkey") % 50, F.lit(".example.org/"), F.col("o_orderkey") % 9000)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), url.alias("url"), (F.col("o_orderkey") % 8).cast("int").alias("depth"))


def empty_frontier(spark) -> DataFrame:
    return cases.inline(spark, [("https://h1.example.org/1", "h1.example.org", "done"), ("https://h2.example.org/2", "h2.example.org", "pending")], "url string, domain string, status string")


@query
def domain_cap(spark, sf):
    return repository.enqueue(empty_frontier(spark), tasks(spark, sf), max_depth=6, per_domain=100).select("url", "domain", "depth", "seq")


@query
def frontier_claim(spark, sf):
    rows = repository.enqueue(empty_frontier(spark), tasks(spark, sf))
    return repository.claim(rows, 20).select("domain", "place", "url")


@query
def frontier_counts(spark, sf):
    return repository.domain_counts(repository.enqueue(empty_frontier(spark), tasks(spark, sf)))


@query
def fail_islands(spark, sf):
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("domain"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("failed"))
    return repository.failure_runs(orders, 8)


@query
def fetch_outcomes(spark, sf):
    codes = F.element_at(F.array(*map(F.lit, (200, 404, 403, 429, 503, 500, 204))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        codes.alias("status_code"),
        F.when(F.col("o_orderkey") % 11 == 0, "timeout").alias("error"),
        (F.col("o_orderkey") % 5 > 0).alias("has_body"),
        (F.col("o_orderkey") % 3).cast("int").alias("attempts"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(12.5)).alias("retry_after"),
    )
    return repository.fetch_outcome(rows).select("id", "new_status", "reason", "success", "wait")


@query
def hard_failures(spark, sf):
    codes = F.element_at(F.array(*map(F.lit, (200, 404, 403, 429, 503, 500, 204))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, codes).alias("status"), F.when(F.col("o_orderkey") % 11 == 0, "timeout").alias("error"))
    return rows.select("id", repository.hard_failure(F.col("status"), F.col("error")).alias("failed"))


@query
def frontier_reset(spark, sf):
    states = F.element_at(F.array(*map(F.lit, ("pending", "in_progress", "done", "error"))), (F.col("seq") % 4 + 1).cast("int"))
    return repository.by_status(repository.reset_in_progress(tasks(spark, sf).withColumn("status", states)))


@query
def recovery_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 8).cast("int").alias("depth"))
    omitted = pages.where("page_id % 5 > 0").select("url").distinct()
    rules = cases.inline(spark, [("spam-farm.example.org", "domain", []), ("blog.ththan.example.net", "prefix", ["/en/"]), ("ththed.example.org", "topical", [])], "host string, mode string, prefixes array<string>")
    return crawl_log.recovery_candidates(pages, omitted, rules).select("page_id", "depth")


@query
def seeds_saved(spark, sf):
    """Suppliers as seeds: half are there, a third come again, some twice."""
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("seed_id"), F.col("s_name").alias("url"), F.col("s_suppkey").alias("seq"))
    new = rows.where("seq % 3 = 0").withColumn("url", F.lit("new")).unionByName(rows.where("seq % 6 = 0").select("seed_id", F.lit("newer").alias("url"), (F.col("seq") + 1).alias("seq")))
    return seeds.save_seeds(rows.where("seq % 2 = 0").drop("seq"), new)


@query
def stale_pages(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("ts").alias("fetched_at"))
    now = events.agg(F.max("fetched_at").alias("now")).first()["now"]
    return repository.stale(events, F.lit(now), 7).select("event_id")


@query
def log_recovery(spark, sf):
    lines = [("x LINKS url=https://a.example.org/1 total=8 in_scope=5 enqueued=0",), ("x LINKS url=https://a.example.org/2 total=8 in_scope=5 enqueued=5",), ("x LINKS url=https://b.example.org/3 total=8 in_scope=5 enqueued=2",), ("y SKIP_THIN_CONTENT url=https://a.example.org/1 depth=2 words=0",), ("y SKIP_THIN_CONTENT url=https://a.example.org/1 depth=3 words=0",)]
    rows = cases.inline(spark, lines, "value string")
    return crawl_log.omitted_links(rows).join(crawl_log.thin_pages(rows), "url", "left").fillna({"depth": -1})


@query
def seed_rows(spark, sf):
    rows = cases.inline(spark, cases.SEEDS, ", ".join(f"{c} string" for c in seeds.COLUMNS))
    return seeds.for_crawler(seeds.clean_seeds(rows), "custom").select("seed_id", "url", "scope_mode")


@query
def seed_tasks(spark, sf):
    rows = cases.inline(spark, cases.SEEDS, ", ".join(f"{c} string" for c in seeds.COLUMNS))
    return seeds.start_tasks(seeds.clean_seeds(rows)).select("seed_id", "url", "depth", "parent_topical")


@query
def redirect_rules(spark, sf):
    rules = cases.inline(spark, [("a.org", "prefix", ["/x"]), ("b.org", "prefix", ["/y"])], "host string, mode string, prefixes array<string>")
    moves = cases.inline(spark, [("https://a.org/", "https://b.org/", 0), ("https://a.org/", "https://c.org/", 0), ("https://a.org/", "https://d.org/", 1)], "url string, final_url string, depth int")
    return U.redirect_rules(rules, moves).withColumn("prefixes", F.array_join("prefixes", " "))


@query
def robots_parsed(spark, sf):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a # why\nAllow: /a/b\nCrawl-delay: 2.5\nDisallow:\n"
    files = cases.inline(spark, [("s", 200, text), ("t", 404, "User-agent: *\nDisallow: /"), ("u", 200, None)], "site string, status_code int, text string")
    return fetch.robots_rules(files).select("site", F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("allow").cast("string"), F.lit("")).alias("allow"), F.coalesce("delay", F.lit(0.0)).alias("delay"))


@query
def retry_headers(spark, sf):
    rows = cases.inline(spark, [(1, "12"), (2, "Thu, 01 Jan 2026 00:01:00 GMT"), (3, "-5"), (4, "soon")], "id int, h string")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return rows.select("id", F.coalesce(repository.retry_after(F.col("h"), now), F.lit(-1.0)).alias("seconds"))


def crawled(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("ts").alias("fetched_at"), (F.col("event_id") % 4).cast("int").alias("depth"), F.lit("domain").alias("scope_rule"), F.col("event_type").alias("crawler_source"), (F.lit(200) + (F.col("event_id") % 3) * 100).cast("int").alias("http_status"), F.col("props").alias("text"))


@query
def resume_requests(spark, sf):
    pages = crawled(spark, sf)
    now = pages.agg(F.max("fetched_at").alias("now")).first()["now"]
    requests = pages.select("url", F.lit("domain").alias("scope_rule")).distinct().withColumn("depth", (F.length("url") - 2).cast("int")).withColumn("forced", F.endswith("url", F.lit("7")))
    return repository.resume_filter(requests, pages, F.lit(now), "click", 1).select("url", "depth")


@query
def frontier_revisit(spark, sf):
    pages = crawled(spark, sf)
    now = pages.agg(F.max("fetched_at").alias("now")).first()["now"]
    last = pages.groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))
    frontier = last.select("url", F.when(F.endswith("url", F.lit("3")), "skipped").otherwise("done").alias("status"))
    return repository.by_status(repository.revisit(frontier, last, F.lit(now), 0.5))


@query
def frontier_blocked(spark, sf):
    frontier = repository.enqueue(empty_frontier(spark), tasks(spark, sf)).withColumn("last_reason", F.lit(None).cast("string"))
    orders = table(spark, sf, "orders").select(F.concat(F.lit("h"), F.col("o_custkey") % 50, F.lit(".example.org")).alias("domain"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("failed"))
    blocked = repository.failure_runs(orders, 9).where("blocked")
    return repository.by_status(repository.drain(frontier, blocked))


@query
def frontier_marked(spark, sf):
    frontier = repository.enqueue(empty_frontier(spark), tasks(spark, sf)).withColumn("last_reason", F.lit(None).cast("string"))
    results = frontier.where("depth < 3").select("url", F.when(F.col("depth") == 0, "pending").when(F.col("depth") == 1, "done").otherwise("skipped").alias("new_status"), F.concat(F.lit("r"), "depth").alias("reason"))
    return repository.mark(frontier, results).groupBy("status", "attempts", F.coalesce("last_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("urls"))


@query
def links_kept(spark, sf):
    pages = table(spark, sf, "pages")
    found = spread(pages).select(F.col("url").alias("from_url"), F.explode(H.extract_links("html", "url")).alias("l")).select("from_url", F.col("l.url").alias("to_url"))
    admitted = found.where(F.contains("to_url", F.lit("/en"))).select(F.col("to_url").alias("url"))
    return repository.new_links(found, admitted)


@query
def text_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.text_path(F.lit("own"), U.domain(F.col("url")), X.content_hash(F.col("html"))).alias("path"))


@query
def valid_judgements(spark, sf):
    _, shown, judgements = relations(spark, sf)
    return repository.shown_only(judgements, shown).select("run_id", "page_id", "relevance")


# --- evaluation and usage


def relations(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    return cases.runs(docs), cases.shown(docs), cases.judgements(labels)


@query
def metrics_runs(spark, sf):
    return evaluation.run_metrics(*relations(spark, sf)).drop("index_name", "judge", "need")


@query
def runs_table(spark, sf):
    runs, shown, judgements = relations(spark, sf)
    runs = runs.withColumn("ts", F.lit("2026-01-01")).withColumn("ms", F.col("run_id") * 1.5).withColumn("query", F.trim("query"))
    return evaluation.run_table(runs, shown, judgements)


@query
def metrics_summary(spark, sf):
    return evaluation.summaries(evaluation.run_metrics(*relations(spark, sf)))


@query
def coverage_novelty(spark, sf):
    return evaluation.coverage_novelty(*relations(spark, sf)).fillna(-1.0)


@query
def metrics_pool(spark, sf):
    runs, _, judgements = relations(spark, sf)
    return evaluation.pool(runs, judgements)


@query
def pk_curve(spark, sf):
    return evaluation.precision_curve(*relations(spark, sf))


@query
def interp_precision(spark, sf):
    return evaluation.interpolated_precision(*relations(spark, sf))


@query
def kappa(spark, sf):
    runs, _, judgements = relations(spark, sf)
    return evaluation.kappa(runs, judgements)


@query
def feedback_pages(spark, sf):
    runs, _, judgements = relations(spark, sf)
    return evaluation.feedback_pages(runs, judgements, "query 3")


@query
def grade_counts(spark, sf):
    return evaluation.grades(cases.judgements(table(spark, sf, "labels")))


def query_log(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")
    q = events.where("event_type = 'view'").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session"), F.concat(F.lit(" Q"), F.col("user_id") % 20).alias("query"), (F.col("event_id") % 7).alias("total"), F.col("value").alias("ms"), (F.col("event_id") % 3 == 0).alias("rocchio"), F.when(F.col("event_id") % 5 == 0, "other").alias("suggestion"))
    c = events.where("event_type = 'click'").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 10 + 1).alias("rank"))
    return q, c


@query
def usage_latency(spark, sf):
    return evaluation.usage(*query_log(spark, sf))


@query
def usage_by_day(spark, sf):
    return evaluation.usage_by_day(query_log(spark, sf)[0]).withColumn("day", F.col("day").cast("string"))


@query
def usage_ctr(spark, sf):
    return evaluation.clicks_by_rank(query_log(spark, sf)[1])


@query
def usage_top_queries(spark, sf):
    return evaluation.top_queries(query_log(spark, sf)[0])


# --- streams


def streamed(spark, sf, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a streaming plan over the events table yields once all of it was read."""
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"s{uuid.uuid4().hex}"
    run = plan(rows).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query
def stream_total(spark, sf):
    return streamed(spark, sf, lambda e: P.running_total(e.select(F.col("event_type").alias("source"), F.col("user_id").alias("bytes"))), "complete")


@query
def stream_windows(spark, sf):
    out = streamed(spark, sf, lambda e: P.look_back(e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("user_id").alias("bytes")), "2 days", "1 day", "1 day"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "source", "pages", "bytes")


@query
def stream_rates(spark, sf):
    out = streamed(spark, sf, lambda e: P.rates(e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("bytes")), "1 day", "1 hour"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "pages", "bytes")


@query
def stream_once(spark, sf):
    return streamed(spark, sf, lambda e: P.once(e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id")).alias("url")), "400 days").select("url"), "append")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}
