"""Functions and operators on small literal inputs."""

import random
import re

import pytest
from lexspark.functions import analysis, html, tables, text, urls
from lexspark.functions.porter import stem
from lexspark.operators import evaluation, index, repository, search
from lexspark.operators.journal import Journal
from lexspark.sources import exports, fetch, seeds
from lexspark.streaming import progress
from pyspark.sql import functions as F

# The published algorithm's examples, one or two a step.
STEMS = {"feed": "feed", "bled": "bled", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "falling": "fall", "hissing": "hiss", "failing": "fail", "sky": "sky", "conditional": "condit", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "callousness": "callous", "triplicate": "triplic", "hopeful": "hope", "allowance": "allow", "adjustable": "adjust", "dependent": "depend", "adoption": "adopt", "effective": "effect", "cease": "ceas", "rate": "rate", "roll": "roll"}
COLLECTION = [
    "Stardew Valley: farming guide, patched on 5 June 2020.",
    "The orchard sold 1,250,000 apples; orchard keepers worked late, late, late.",
    "Los jugadores llegaron el 8 de enero de 2019. La guía tiene un nivel de espadas.",
    "CAFÉ Noir and Cafe crème: painting, painter, paints.",
    "Street Fighter night, June 5, 2020, 06/05/2020, 2020-06-05: one day.",
    "harbour " * 25,
    "",
    "Multi player co-op of World of Warcraft on Game Boy and PlayStation 4.",
]


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]


def collection(spark):
    return spark.createDataFrame(list(enumerate(COLLECTION)), "doc_id long, text string")


@pytest.fixture(scope="module")
def full(spark):
    return index.build(collection(spark), analysis.FULL)


@pytest.fixture(scope="module")
def basic(spark):
    return index.build(collection(spark), analysis.BASIC)


def found(spark, ix, query):
    docs = collection(spark)
    meta = docs.select("doc_id", F.lit("x.org").alias("site"), F.lit("en").alias("language"), F.lit("s").alias("source"))
    return [r["doc_id"] for r in search.search(ix, query, docs, meta).orderBy("rank").collect()]


def test_search_full(spark, full):
    assert found(spark, full, "orchard keepers")[0] == 1
    assert set(found(spark, full, "5 de junio de 2020")) == {0, 4}
    assert found(spark, full, "cafe -noir") == []
    assert found(spark, full, "world of warcraft") == [7]


def test_search_operators(spark, basic):
    assert found(spark, basic, '"keepers worked late"') == [1]
    assert found(spark, basic, '"late keepers"') == []
    assert found(spark, basic, "harb*") == [5]
    assert found(spark, basic, "street* -night") == []
    assert found(spark, basic, "orchard +zzz") == []
    assert found(spark, basic, "site:org idioma:en") == list(range(8))
    assert found(spark, basic, "late -site:x.org") == []


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("a b  -c +d", [("plain", "", "a b"), ("word", "-", "c"), ("word", "+", "d")]),
        ('x "p q"glued y', [("plain", "", "x"), ("phrase", "", "p q"), ("plain", "", "y")]),
        ('"" "open', [("plain", "", '"" "open')]),
        ('-"p q" +"r"', [("phrase", "-", "p q"), ("phrase", "+", "r")]),
        ("site:A.org -site:b idioma:es site: -", [("site", "", "A.org"), ("site", "-", "b"), ("idioma", "", "es"), ("plain", "", "site: -")]),
        ("ab* a* -cd* **", [("prefix", "", "ab"), ("plain", "", "a*"), ("prefix", "-", "cd"), ("plain", "", "**")]),
        ('a"b c" d', [("plain", "", 'a"b c" d')]),
    ],
)
def test_clauses(query, want):
    assert list(search.clauses(query)) == want


def test_answer(spark, basic):
    docs = collection(spark).selectExpr("doc_id", "concat('https://www.X.org/', doc_id) url", "if(doc_id = 1, ' CafÃ© orchard ', null) title", "text", "'en' language", "'s' source")
    page = search.answer(basic, "orchard late", docs)
    r = page.results.first()
    assert (page.total, page.pages, page.unknown, page.suggestion, page.notice) == (1, 1, [], None, None)
    assert (r["rank"], r["doc_id"], r["title"], r["domain"]) == (1, 1, "Café orchard", "www.x.org") and "<mark>orchard</mark>" in r["snippet"]
    lost = search.answer(basic, "harbuor zzz -late", docs, feedback=([], [3]))
    assert (lost.total, lost.unknown, lost.suggestion) == (0, ["harbuor", "zzz"], "harbour zzz -late") and lost.notice == search.NO_FEEDBACK
    back = search.answer(basic, "orchard", docs, feedback=([5], []))
    assert back.total == 2 and {r["doc_id"] for r in back.results.collect()} == {1, 5}
    assert search.answer(basic, "orchard", docs, page=2).results.count() == 0


def test_journal(spark, basic, tmp_path):
    docs = collection(spark).selectExpr("doc_id", "concat('https://x.org/', doc_id) url", "'' title", "text", "'en' language", "'s' source")
    book = Journal(spark, str(tmp_path))
    found_ = search.answer(basic, "harbour", docs)
    run = book.run("ann", None, " harbour ", "basico", found_)
    with pytest.raises(ValueError):
        book.judge(run, 3, 1)
    with pytest.raises(ValueError):
        book.run(" ", None, "x", "basico", found_)
    book.judge(run, 5, 0)
    book.judge(run, 5, 2, known=True)
    assert [(r["relevance"], r["known"]) for r in book.judgements().collect()] == [(2, True)] and book.feedback("Harbour") == ([5], [])
    book.click(book.query("s", "harbour", "basico", found_), 5, 1)
    assert {k: v.count() for k, v in book.tables().items()} == {"queries": 1, "clicks": 1, "runs": 1, "shown": 1, "judgements": 1}


@pytest.mark.parametrize("policy", analysis.POLICIES.values(), ids=lambda p: p.name)
def test_index_by_hand(spark, policy):
    ix = index.build(collection(spark), policy)
    terms = {r["doc_id"]: list(r["t"]) for r in collection(spark).select("doc_id", analysis.analyze(F.col("text"), policy).alias("t")).collect()}
    postings = {(r["doc_id"], r["term"]): r["tf"] for r in ix.postings.collect()}
    assert postings == {(d, t): ts.count(t) for d, ts in terms.items() for t in ts}
    docs = {r["doc_id"]: (r["length"], r["distinct_terms"]) for r in ix.docs.collect()}
    assert docs == {d: (len(ts), len(set(ts))) for d, ts in terms.items()}
    assert ix.docs.where("doc_id = 6").first()["norm"] == 0


def test_index_saved_and_loaded(spark, basic, tmp_path, same):
    basic.save(str(tmp_path / "ix"), buckets=3)
    back = index.Index.load(spark, str(tmp_path / "ix"))
    assert back.policy == basic.policy and back.n_docs == 8
    same(back.vocab.toPandas(), basic.vocab.toPandas())


def test_policy_from_ini():
    text_ = "[normalizacion]\nplegado = x.txt\nminusculas = si\nfechas = on\nnumeros = no\nstopwords = no\nstemming = porter ; c\n[indice]\nnombre = mine\n"
    p = analysis.Policy.from_ini(text_)
    assert (p.name, p.fold, p.lower, p.dates, p.numbers, p.stopwords, p.stems) == ("mine", True, True, True, False, False, True)
    assert analysis.Policy.from_json(p.to_json()) == p


def test_fold_table():
    folding = tables.folding()
    assert folding["é"] == "e" and folding["ß"] == "ss" and folding["Ł"] == "L" and "a" not in folding
    assert folding["Ŀ"] == "L" and folding["ŀ"] == "l" and len(folding) == 523


def test_sizes_of_fixed_lists():
    sizes = {"STOPWORDS": 228, "TOPIC_WORDS": 31, "ENGLISH": 25, "MONTHS": 12}
    assert {k: len(getattr(tables, k)) for k in sizes} == sizes
    assert (len(tables.rules(tables.NAMES)), len(tables.rules(tables.THESAURUS))) == (50, 90)
    assert {"will", "would", "tambien"} <= tables.STOPWORDS and {"game", "gamers", "dlc"} <= set(tables.TOPIC_WORDS)
    assert fetch.MOST_BYTES == 5_000_000


def test_broad_vocabulary_joins_by_shuffle(spark, monkeypatch, same):
    want = index.build(collection(spark), analysis.BASIC)
    monkeypatch.setattr(index, "BROADCAST_TERMS", 0)
    same(index.build(collection(spark), analysis.BASIC).docs.toPandas(), want.docs.toPandas())


def test_snippet_by_hand(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["hit", "a&b", "x", "yy"]) for _ in range(rng.choice([0, 5, 31, 32, 33, 90])))) for i in range(25)]
    got = {r["doc_id"]: r["snippet"] for r in search.snippets(spark.createDataFrame(docs, "doc_id long, text string"), ["hit"], analysis.BASIC).collect()}
    for i, t in docs:
        w = t.split()
        if not w:
            assert i not in got
            continue
        hits = [x == "hit" for x in w]
        sums = [sum(hits[k : k + 32]) for k in range(len(w) - 31)] if len(w) >= 32 else [int(h) for h in hits]
        at = sums.index(max(sums)) if any(hits) else 0
        body = " ".join("<mark>hit</mark>" if x == "hit" else x.replace("&", "&amp;") for x in w[at : at + 32])
        assert got[i] == ("… " if at else "") + body + (" …" if at + 32 < len(w) else "")


@pytest.mark.parametrize("few", [200_000, 0])
def test_save_outcomes_in_order(spark, monkeypatch, few):
    monkeypatch.setattr(repository, "FEW_ARRIVALS", few)
    monkeypatch.setattr(repository, "TIME_PARTS", 5)
    rng = random.Random(9)
    pages = {f"u{i}": f"h{i % 3}" for i in range(4)}
    rows = [(i, f"u{rng.randrange(30)}", f"h{int(rng.random() ** 2 * 25)}") for i in range(150)]
    got = {r["seq"]: r["outcome"] for r in repository.save_outcomes(spark.createDataFrame(rows, "seq long, url string, content_hash string"), spark.createDataFrame(list(pages.items()), "url string, content_hash string")).collect()}
    want = {}
    for i, u, h in rows:
        want[i] = "unchanged" if pages.get(u) == h else "updated" if u in pages else "duplicate_content" if h in pages.values() else "saved"
        if want[i] in ("updated", "saved"):
            pages[u] = h
    assert got == want


def test_save_outcomes_forgets_replaced_contents(spark):
    save = lambda *rows: [r["outcome"] for r in repository.save_outcomes(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, url string, content_hash string")).orderBy("seq").collect()]
    assert save(("u1", "h1"), ("u1", "h2"), ("u2", "h1")) == ["saved", "updated", "saved"]
    assert save(("u1", "h1"), ("u2", "h2"), ("u2", "h1"), ("u2", "h1")) == ["saved", "saved", "updated", "unchanged"]


def test_html_page(spark):
    page = """<html><head><title> T &amp; x </title></head><body><nav><a href="/n">n</a></nav>
    <div id="mw-content-text"><div class="toc">skip</div><p>One<br>two</p><table><tr><td>a</td><td>b</td></tr></table>
    <a href="#x">no</a><a href="mailto:x">no</a><a href="/p?q=1">  go  there </a><a href="/p?q=1">again</a><script>x</script></div></body></html>"""
    r = spark.createDataFrame([(page, "https://x.org/a/b"), ("", "https://x.org"), ("<p>un<b>closed", None), (None, None)], "h string, b string").select(html.extract_page("h", "b").alias("p")).collect()
    assert r[0]["p"]["title"] == "T & x"
    assert r[0]["p"]["text"].startswith("One\ntwo\n") and "a b" in r[0]["p"]["text"].split("\n")
    assert [(x["url"], x["anchor"]) for x in r[0]["p"]["links"]] == [("https://x.org/n", "n"), ("https://x.org/p?q=1", "go there")]
    assert "skip" not in r[0]["p"]["text"] and r[1]["p"]["text"] == "" and r[2]["p"]["text"] == "unclosed" and r[3]["p"]["title"] == ""


def test_topical(spark):
    keys = ["video_game", "video-game", "game", "a a"]
    rows = [("video game video-game video_game", 6), ("a a a", 1), ("xvideo gamepad", 1), ("GAME game games", 2), ("", 0)]
    got = spark.createDataFrame(rows, "t string, n int").select(text.topical_score(F.col("t"), keys).alias("s"), "n").collect()
    assert [r["s"]["hits"] for r in got] == [r["n"] for r in got]


def test_seeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("seed_id,url,subtema,scope_mode,idioma,crawler\ns1, https://a.org/x ,t,,en,custom\n,https://b.org,t,domain,en,\ns3,https://a.org/y,t,domain,en,scrapy\ns4,https://c.org/p.pdf,t,domain,en,\n")
    rows = seeds.read_seeds(spark, str(tmp_path / "s.csv"))
    assert [r["seed_id"] for r in rows.orderBy("seed_id").collect()] == ["s1", "s3", "s4"]
    assert seeds.shared_hosts(rows).first()["crawlers"] == ["custom", "scrapy"]
    assert seeds.for_crawler(rows, "custom").count() == 2
    assert [r["url"] for r in seeds.start_tasks(rows).orderBy("url").collect()] == ["https://a.org/x", "https://a.org/y"]


def test_retry_and_backoff(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    r = spark.createDataFrame([("12",), ("Thu, 01 Jan 2026 00:01:00 GMT",), ("soon",), (None,)], "h string").select(repository.retry_after(F.col("h"), now).alias("s")).collect()
    assert [x["s"] for x in r] == [12.0, 60.0, None, None]
    b = spark.range(1, 8).select(repository.backoff(F.col("id"), F.lit(None).cast("double")).alias("s")).collect()
    assert [x["s"] for x in b] == [30, 60, 120, 240, 480, 900, 900]


class Query:
    stopped = False

    def stop(self):
        self.stopped = True


def test_stop_at():
    for total, free, want in ((5, 3 * progress.GIB, False), (10, None, True), (5, progress.GIB, True)):
        q = Query()
        assert progress.stop_at(q, lambda total=total: total, 10, (lambda free=free: free) if free else None) is want and q.stopped is want


def test_durations():
    g = 1024**2
    assert progress.remaining(2048 * g, 1048 * g, 1048 * g, 60) == "?"
    assert progress.remaining(2048 * g, 1048 * g, 1058 * g, 60) == "1h39m"
    assert progress.remaining(2048 * g, 1048 * g, 2058 * g, 60) == "0s"


def test_metric_formulas(spark):
    runs = spark.createDataFrame([(1, "a", "n", "q", "i")], "run_id long, judge string, need string, query string, index_name string")
    shown = spark.createDataFrame([(1, i + 1, i) for i in range(3)], "run_id long, rank int, page_id long")
    marks = spark.createDataFrame([(1, 0, 1, False), (1, 2, 1, True), (1, 9, 1, True)], "run_id long, page_id long, relevance int, known boolean")
    r = evaluation.run_metrics(runs, shown, marks).first()
    assert r["ap"] == pytest.approx((1 + 2 / 3) / 3) and r["rr"] == 1 and r["p5"] == pytest.approx(0.4)
    assert r["coverage"] == 0.5 and r["novelty"] == 0.5


def test_redirects_and_upsert(spark):
    rules = spark.createDataFrame([("a.org", "domain", [])], "host string, mode string, prefixes array<string>")
    moves = spark.createDataFrame([("https://a.org/", "https://b.org/", 0), ("https://a.org/", "https://c.org/", 1)], "url string, final_url string, depth int")
    assert {r["host"] for r in urls.redirect_rules(rules, moves).collect()} == {"a.org", "b.org"}
    old = spark.createDataFrame([(1, 1, 0)], "run_id int, page_id int, relevance int")
    new = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "run_id int, page_id int, relevance int")
    assert {(r["page_id"], r["relevance"]) for r in repository.upsert(old, new, ["run_id", "page_id"], "relevance").collect()} == {(1, 2), (2, 1)}


def test_exports(spark, tmp_path):
    words = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "rank int, word string, freq long")
    exports.words_csv(words, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 2
    lines = spark.createDataFrame([("a => b => 3",), ("x",)], "value string")
    assert [tuple(r) for r in exports.read_word_list(lines).collect()] == [("a => b", 3)]
    assert "| 1 | a | 3 |" in exports.report_table(words.orderBy("rank"))


def test_robots_longest_rule(spark):
    u = spark.createDataFrame([("s", "/a/b"), ("s", "/a/b"), ("s", "/a"), ("t", "/x"), ("s", "/tie")], "site string, path string")
    rules = spark.createDataFrame([("s", "/a", False), ("s", "/a/b", True), ("s", "/tie", False), ("s", "/tie", True), ("s", None, None)], "site string, path string, allow boolean")
    assert sorted((r["site"], r["path"]) for r in fetch.robots_allowed(u, rules).collect()) == [("s", "/a/b"), ("s", "/a/b"), ("s", "/tie"), ("t", "/x")]


def test_edits_by_hand(spark):
    got = set(spark.createDataFrame([("ab",)], "w string").select(text.edits(F.col("w"))).first()[0])
    c = "abcdefghijklmnopqrstuvwxyz0123456789"
    want = {"b", "a", "ba"} | {x + "b" for x in c} | {"a" + x for x in c} | {x + "ab" for x in c} | {"a" + x + "b" for x in c} | {"ab" + x for x in c}
    assert got == want


def test_namespace_patterns():
    p = urls.namespace_patterns()
    assert [len(x) for x in p] == sorted((len(x) for x in p), reverse=True) and "usuario_discusi%c3%b3n%3a" in p
    assert re.fullmatch(r"[^A-Z]*", "".join(p))
