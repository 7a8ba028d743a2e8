"""DuckDB SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

from lexspark.plans import cases

# Fixed values, spelled out here so that the library's own tables are held against them.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves also may s t al algo algunas algunos ante antes como con contra cual
cuando de del desde donde durante e el ella ellas ellos en entre era eran es esa esas ese eso esos esta estaba estado
estan este esto estos fue fueron ha habia han hasta hay la las le les lo los mas me mi mis mucho muy nada ni no nos
nosotros o os otra otras otro otros para pero poco por porque que quien se sea ser si sin sido sobre son su sus
tambien te tiene tienen todo todos tu tus un una uno unos y ya yo
""".split()
REPORT_STOP_WORDS = """
a al algo algunas algunos ante aquel aquella aquellas aquello aquellos aqui arriba atras bajo bien cada como con contra
cual cuando de del desde donde dos e el ella ellas ellos en entre era eramos eran eras es esa esas ese eso esos esta
estaba estaban estamos estan este esto estos fin fue fuera fueron fui ha habia habian hace hacia han hasta hay he hemos
hoy hubo la las le lo los mas me mi mis mucho muy nada ni no nos nosotros nunca o os otro para pero poco por porque que
quien se ser si sin sobre so solamente solo somos son soy su sus tambien te ti tiene tienen todo tu tus u un una uno
usted ustedes y ya yo the a an and are as at be been being but by could did do does doing for from had has have having
he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on
once only or other our ours ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up very was we were what when where which while
who whom why with would you your yours yourself yourselves
""".split()
ENGLISH = "the be to of and a in that have i it for not on with he as you do at this but his by from".split()
SPANISH = "de la que el en y a los del se las por un para con no una su al lo como mas más pero sus le es o este esta esto".split()


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


TOKENS = r"""
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(replace(strip_accents(coalesce(text, '')), 'ß', 'ss')), '[\p{L}\p{N}]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) BETWEEN 1 AND 40 GROUP BY ALL)"""
INDEX = (
    TOKENS
    + """,
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, log2((SELECT n FROM n) / count(*)) AS idf FROM p GROUP BY term),
dn AS (SELECT d.doc_id, coalesce(length, 0) AS length, coalesce(distinct_terms, 0) AS distinct_terms, coalesce(norm, 0) AS norm FROM documents d LEFT JOIN (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS length, count(*) AS distinct_terms, sqrt(sum(pow((1 + log2(tf)) * idf, 2))) AS norm FROM p JOIN v USING (term) GROUP BY doc_id) USING (doc_id))"""
)
LETTERS = r"""w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM documents), f AS (SELECT word, count(*) AS freq FROM w GROUP BY word)"""
QUERY_TERMS = r"""qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(replace(strip_accents(text), 'ß', 'ss')), '[\p{L}\p{N}]+')) AS term FROM benchmark)"""


def cosine(terms: str, where: str = "", k: int = 10, keep_id: bool = False, digits: int = 9) -> str:
    """Ranked documents of the query terms that the CTE ``qt`` (query_id, term) holds."""
    return f"""WITH {INDEX}, {terms},
q AS (SELECT query_id, term, idf, (1 + log2(count(*))) * idf AS w FROM qt JOIN v USING (term) GROUP BY query_id, term, idf),
qn AS (SELECT query_id, CASE WHEN sum(w * w) = 0 THEN 1 ELSE sqrt(sum(w * w)) END AS nq FROM q GROUP BY query_id),
s AS (SELECT query_id, doc_id, round(sum(w * (1 + log2(tf)) * idf) / any_value(nq) / any_value(norm), 9) AS score
  FROM p JOIN q USING (term) JOIN qn USING (query_id) JOIN dn USING (doc_id) WHERE w > 0 GROUP BY query_id, doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s {where})
SELECT {"query_id, " if keep_id else ""}rank, doc_id, score FROM r WHERE rank <= {k}"""


def words(*terms: str) -> str:
    return f"qt AS (SELECT 0 AS query_id, term FROM (VALUES {', '.join(f"('{t}')" for t in terms)}) x(term))"


ROCCHIO = f"""WITH {INDEX},
g AS (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1 ORDER BY doc_id LIMIT 3),
b AS (SELECT doc_id FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 3),
vec AS (SELECT doc_id, term, (1 + log2(tf)) * idf / norm AS w FROM p JOIN v USING (term) JOIN dn USING (doc_id)),
parts AS (SELECT term, 0.75 / 3 * w AS w FROM vec JOIN g USING (doc_id) UNION ALL SELECT term, -0.15 / 3 * w FROM vec JOIN b USING (doc_id)),
total AS (SELECT term, sum(w) AS w, term IN ('stupid', 'trash') AS known FROM parts GROUP BY term),
chosen AS (SELECT * FROM total WHERE known AND w <> 0 UNION ALL (SELECT * FROM total WHERE NOT known AND w > 0 ORDER BY round(w, 12) DESC, term LIMIT 10))"""

ASKED = "aw AS (SELECT * FROM (VALUES ('stupidd'), ('trsah'), ('worthles'), ('thee'), ('stupid'), ('qqqqqqqq')) x(word))"
#: Of the CTE ``aw`` (word): the vocabulary's best term one edit away, for words it lacks; an edit puts in only letters a-z and digits.
SUGGESTED = """, sg AS (SELECT word, term AS suggestion, df FROM (SELECT word, term, df, row_number() OVER (PARTITION BY word ORDER BY df DESC, term) AS i FROM aw JOIN v ON damerau_levenshtein(lower(word), term) = 1
  WHERE regexp_full_match(term, '[a-z0-9]+') AND lower(word) NOT IN (SELECT term FROM v)) WHERE i = 1)"""

RUNS = """
rn AS (SELECT DISTINCT doc_id % 40 AS run_id FROM documents),
runs AS (SELECT run_id, 'j' || (run_id % 4) AS judge, CASE WHEN run_id % 10 = 0 THEN 'query ' || (run_id % 5) ELSE 'need' || (run_id % 10) END AS need, 'query ' || (run_id % 5) AS query, 'i' || (run_id % 3) AS index_name FROM rn),
sp AS (SELECT DISTINCT doc_id % 40 AS run_id, (doc_id // 40) % 30 AS page_id FROM documents),
shown AS (SELECT run_id, page_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page_id * 7 % 31, page_id) AS rank FROM sp) WHERE rank <= 10),
j AS (SELECT doc_id % 40 AS run_id, (doc_id // 40) % 30 AS page_id, max(CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 2 ELSE 1 END ELSE 0 END) AS relevance, max(toxic) AS known FROM labels GROUP BY ALL),
judged AS (SELECT DISTINCT run_id FROM j),
pool AS (SELECT need, page_id, max(relevance) AS relevance FROM j JOIN runs USING (run_id) GROUP BY ALL),
rel AS (SELECT need, count(*) FILTER (relevance >= 1) AS R FROM pool GROUP BY need),
ideal AS (SELECT need, sum((pow(2, relevance) - 1) / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY need ORDER BY relevance DESC, page_id) AS i FROM pool) WHERE i <= 10 GROUP BY need),
l AS (SELECT run_id, judge, index_name, need, rank, page_id, coalesce(relevance, 0) AS rel, CASE WHEN relevance >= 1 THEN 1 ELSE 0 END AS hit FROM runs JOIN judged USING (run_id) JOIN shown USING (run_id) LEFT JOIN j USING (run_id, page_id)),
h AS (SELECT *, sum(hit) OVER (PARTITION BY run_id ORDER BY rank) AS hits FROM l),
mk AS (SELECT judge, need, page_id, max(relevance) AS relevance, max(known) AS known FROM j JOIN runs USING (run_id) GROUP BY ALL HAVING max(relevance) >= 1),
kr AS (SELECT judge, need, sum(known) AS kr FROM mk GROUP BY ALL),
ra AS (SELECT run_id, count(*) AS ra, sum(known) AS kra FROM runs JOIN judged USING (run_id) JOIN shown USING (run_id) JOIN mk USING (judge, need, page_id) GROUP BY run_id),
cn AS (SELECT run_id, CASE WHEN coalesce(kr, 0) > 0 THEN round(coalesce(kra, 0) / kr, 9) END AS coverage, CASE WHEN coalesce(ra, 0) > 0 THEN round((ra - kra) / ra, 9) END AS novelty FROM runs JOIN judged USING (run_id) LEFT JOIN kr USING (judge, need) LEFT JOIN ra USING (run_id)),
a AS (SELECT run_id, judge, index_name, need, coalesce(max(R), 0) AS R, coalesce(max(ideal), 0) AS ideal, sum(hit) FILTER (rank <= 5) AS h5, sum(hit) FILTER (rank <= 10) AS hk, coalesce(sum(hit) FILTER (rank <= R), 0) AS hr,
  sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS ap, min(rank) FILTER (hit = 1) AS first, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM h LEFT JOIN rel USING (need) LEFT JOIN ideal USING (need) GROUP BY ALL),
m AS (SELECT run_id, judge, index_name, need, R, round(h5 / 5, 9) AS p5, round(hk / 10, 9) AS pk, round(CASE WHEN R > 0 THEN ap / R ELSE 0 END, 9) AS ap, round(CASE WHEN R > 0 THEN hr / R ELSE 0 END, 9) AS r_precision,
  round(CASE WHEN R > 0 AND hk > 0 THEN 2 * (hk / 10) * (hk / R) / (hk / 10 + hk / R) ELSE 0 END, 9) AS fk, round(coalesce(1 / first, 0), 9) AS rr, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg, coverage, novelty FROM a JOIN cn USING (run_id))"""
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("p5", "pk", "ap", "r_precision", "fk", "rr", "ndcg", "coverage", "novelty"))

HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
LOG_Q = "q AS (SELECT event_id AS id, ts, user_id AS session, 'q' || (user_id % 20) AS query, event_id % 7 AS total, value AS ms, event_id % 3 = 0 AS rocchio, event_id % 5 = 0 AS suggested FROM events WHERE event_type = 'view'), c AS (SELECT user_id AS query_id, event_id % 10 + 1 AS rank FROM events WHERE event_type = 'click')"
LISTED_PHRASES = f"(VALUES {values([(i, f'bought {a}'.strip() + ' again', f'bought {b}'.strip() + ' again') for i, (_, a, b) in enumerate(cases.PHRASES)])}) x(i, a, b)"

TASKS = """
o AS (SELECT o_orderkey AS seq, 'h' || (o_custkey % 50) || '.example.org' AS domain, 'https://h' || (o_custkey % 50) || '.example.org/' || (o_orderkey % 9000) AS url, CAST(o_orderkey % 8 AS INT) AS depth FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM o WHERE depth <= 6) WHERE n = 1 AND url NOT IN ('https://h1.example.org/1', 'https://h2.example.org/2')),
fr AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq, url) + CASE WHEN domain IN ('h1.example.org', 'h2.example.org') THEN 1 ELSE 0 END AS place FROM f)"""
FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
TOPIC_HITS = r"""SELECT doc_id, ws, len(list_filter(ws, lambda x: x IN ('stupid', 'trash'))) + (length(j) - length(replace(j, 'worth less', ''))) // 10 + (length(j) - length(replace(j, 'of the', ''))) // 6 AS hits FROM (
  SELECT doc_id, ws, array_to_string(ws, ' ') AS j FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:''[a-z]+)?') AS ws FROM documents))"""


def saved_in_turn(arrivals: str, pages: str = "MAP {}") -> str:
    """Outcomes of the CTE ``ar`` (seq, url, h) by walking it row by row with the table of pages at hand (url to hash)."""
    return f"""WITH RECURSIVE {arrivals},
n AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM ar),
s AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS outcome, CAST({pages} AS MAP(VARCHAR, VARCHAR)) AS held
  UNION ALL
  SELECT i, seq, url, outcome, CASE WHEN outcome IN ('saved', 'updated') THEN map_concat(held, MAP {{url: h}}) ELSE held END FROM (
    SELECT n.i, n.seq, n.url, n.h, s.held, CASE WHEN s.held[n.url] = n.h THEN 'unchanged' WHEN s.held[n.url] IS NOT NULL THEN 'updated' WHEN list_contains(map_values(s.held), n.h) THEN 'duplicate_content' ELSE 'saved' END AS outcome
    FROM s JOIN n ON n.i = s.i + 1))
"""


SQL: dict[str, str] = {
    "index_postings": f"WITH {TOKENS} SELECT * FROM p",
    "index_vocab": f"WITH {INDEX} SELECT term, df, cf, round(idf, 9) AS idf FROM v",
    "index_docs": f"WITH {INDEX} SELECT doc_id, length, distinct_terms, round(norm, 6) AS norm FROM dn",
    "index_stats": f"""WITH {INDEX} SELECT * FROM (SELECT count(*) AS terms, CAST(sum(cf) AS BIGINT) AS tokens, CAST(sum(df) AS BIGINT) AS postings, count(*) FILTER (cf = 1) AS hapax, quantile_cont(df, 0.5) AS df_median, count(*) FILTER (df = 1) AS df_one, round(count(*) FILTER (cf = 1) / count(*), 9) AS hapax_share FROM v),
        (SELECT count(*) AS docs, round(avg(length), 9) AS length_mean, quantile_cont(length, 0.5) AS length_median, max(length) AS length_max, count(*) FILTER (length = 0) AS empty_docs FROM dn)""",
    "index_varbyte_bytes": f"""WITH {TOKENS}, g AS (SELECT term, tf, (doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0)) * 2 + CASE WHEN tf = 1 THEN 1 ELSE 0 END AS c FROM p)
        SELECT CAST(sum(greatest(1, ceil(log2(c + 1) / 7)) + CASE WHEN tf > 1 THEN greatest(1, ceil(log2(tf + 1) / 7)) ELSE 0 END) AS BIGINT) AS bytes, count(DISTINCT term) AS terms FROM g""",
    "index_vocab_stop": f"WITH {TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p WHERE term NOT IN ({listed(STOP_WORDS)}) GROUP BY term",
    "vocab_compare": f"WITH {INDEX}, {LETTERS} SELECT CASE WHEN f.word IS NULL THEN 'only_a' WHEN v.term IS NULL THEN 'only_b' WHEN v.df = f.freq AND v.cf = f.freq THEN 'equal' ELSE 'different' END AS status, count(*) AS terms FROM v FULL JOIN f ON v.term = f.word GROUP BY 1",
    "top_terms": f"WITH {INDEX} SELECT term, df, cf FROM v ORDER BY df DESC, term LIMIT 40",
    "fold_letters": r"SELECT replace(strip_accents(w), 'ß', 'ss') AS word, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS w FROM documents) GROUP BY 1",
    "dates_numbers": """SELECT o_orderkey, 'on ' || CASE o_orderkey % 7 WHEN 6 THEN 'abr 31, 19999' ELSE strftime(CAST(o_orderdate AS DATE), '%Y%m%d') END || ' for ' || CAST(floor(o_totalprice) AS BIGINT) || ' the ' || (o_orderkey % 90 + 1) AS result FROM orders""",
    "analyze_phrases": f"SELECT p_partkey, a AS result FROM part JOIN {LISTED_PHRASES} ON i = p_partkey % 9",
    "analyze_full": f"SELECT p_partkey, replace(b, ' again', '') AS result FROM part JOIN {LISTED_PHRASES} ON i = p_partkey % 9",
    "repair_encoding": "SELECT doc_id, md5(text) AS result FROM documents WHERE strlen(text) <> length(text)",
    "search_cosine": cosine(QUERY_TERMS, keep_id=True),
    "search_classic": f"""WITH {INDEX}, {QUERY_TERMS},
        q AS (SELECT query_id, term, count(*) AS qtf, 1 + ln((SELECT n FROM n) / (df + 1)) AS i FROM qt JOIN v USING (term) GROUP BY query_id, term, df),
        s AS (SELECT query_id, doc_id, round(sum(qtf * sqrt(tf) * i * i) / sqrt(any_value(length)), 9) AS score FROM p JOIN q USING (term) JOIN dn USING (doc_id) GROUP BY query_id, doc_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) SELECT * FROM r WHERE rank <= 10""",
    "search_required_excluded": cosine(words("stupid", "trash"), "WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'trash') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'worthless')"),
    "search_site_lang": cosine(words("stupid", "trash"), "WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src3', 'src5') AND lang = 'en')"),
    "search_filter_only": "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, 0.0 AS score FROM documents WHERE source = 'src4' AND lang = 'de') WHERE rank <= 20",
    "search_prefix": cosine(
        "ex AS (SELECT term FROM v WHERE starts_with(term, 'worthl') ORDER BY df DESC, term LIMIT 50), no AS (SELECT term FROM v WHERE starts_with(term, 'stup') ORDER BY df DESC, term LIMIT 50), qt AS (SELECT 0 AS query_id, term FROM ex)",
        "WHERE doc_id NOT IN (SELECT doc_id FROM p JOIN no USING (term))",
    ),
    "search_phrase": cosine(
        words("all", "rights", "reserved"),
        r"WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(replace(strip_accents(text), 'ß', 'ss')), '[\p{L}\p{N}]+'), ' ') || ' ' AS j FROM documents) WHERE contains(j, ' all rights reserved '))",
        20,
    ),
    "search_unknown_term": cosine(words("stupid", "zzzznowhere")),
    "search_rocchio": f"""{ROCCHIO}, q0 AS (SELECT term, idf AS w FROM v WHERE term IN ('stupid', 'trash')), nq AS (SELECT sqrt(sum(w * w)) AS nq FROM q0),
        q AS (SELECT term, sum(w) AS w FROM (SELECT * FROM q0 UNION ALL SELECT term, w * (SELECT nq FROM nq) FROM chosen JOIN v USING (term)) GROUP BY term), qn AS (SELECT sqrt(sum(w * w)) AS n2 FROM q),
        s AS (SELECT doc_id, round(sum(w * (1 + log2(tf)) * idf) / (SELECT n2 FROM qn) / any_value(norm), 9) AS score FROM p JOIN q USING (term) JOIN v USING (term) JOIN dn USING (doc_id) WHERE w > 0 GROUP BY doc_id)
        SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 7) AS score FROM s) WHERE rank <= 10""",
    "rocchio_terms": f"{ROCCHIO} SELECT term, round(w, 9) AS w, known FROM chosen",
    "zipf_rank": f"WITH {LETTERS} SELECT rank, word, freq, round(max(freq) OVER () / rank, 9) AS reference FROM (SELECT row_number() OVER (ORDER BY freq DESC, word) AS rank, * FROM f) WHERE rank <= 1000",
    "top_words_nostop": f"WITH {LETTERS} SELECT word, freq FROM f WHERE length(word) >= 3 AND word NOT IN ({listed(REPORT_STOP_WORDS)}) ORDER BY freq DESC, word LIMIT 50",
    "corpus_totals": f"WITH {LETTERS} SELECT * FROM (SELECT count(*) AS docs, count(*) FILTER (text IS NULL) AS missing, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents), (SELECT CAST(sum(freq) AS BIGINT) AS words, count(*) AS distinct_words FROM f)",
    "corpus_by_source_lang": r"WITH d AS (SELECT coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, len(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS w, strlen(coalesce(text, '')) AS b FROM documents) SELECT 'source' AS kind, source AS key, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, CAST(sum(b) AS BIGINT) AS bytes FROM d GROUP BY source UNION ALL SELECT 'lang', lang, count(*), CAST(sum(w) AS BIGINT), CAST(sum(b) AS BIGINT) FROM d GROUP BY lang",
    "corpus_by_domain": f"WITH d AS (SELECT {HOST} AS domain, strlen(html) AS b FROM pages) SELECT domain, count(*) AS pages, CAST(sum(b) AS BIGINT) AS bytes, round(sum(b) / (SELECT sum(b) FROM d) * 100, 6) AS share FROM d GROUP BY domain ORDER BY bytes DESC, domain LIMIT 15",
    "progress_by_source": "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type AS source, count(*) AS pages, CAST(sum(user_id) AS BIGINT) AS bytes, count(*) FILTER (now - ts <= INTERVAL 10 MINUTE) AS pages_10m, count(*) FILTER (now - ts <= INTERVAL 60 MINUTE) AS pages_60m, CAST(coalesce(sum(user_id) FILTER (now - ts <= INTERVAL 60 MINUTE), 0) AS BIGINT) AS bytes_60m FROM events, n GROUP BY event_type",
    "thin_content": f"SELECT * FROM (SELECT doc_id, CASE WHEN {FLAT} = '' THEN 0 ELSE len(string_split({FLAT}, ' ')) END AS words FROM documents) WHERE words < 50",
    "lang_detect": f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(left(coalesce(text, ''), 20000), '[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ'']+')[:2000], lambda x: lower(x)) AS ws FROM documents),
        c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x IN ({listed(ENGLISH)}))) / len(ws) AS en, len(list_filter(ws, lambda x: x IN ({listed(SPANISH)}))) / len(ws) AS es FROM d)
        SELECT doc_id, CASE WHEN n < 20 THEN 'other' WHEN en >= 0.04 AND en > es THEN 'en' WHEN es >= 0.04 AND es > en THEN 'es' ELSE 'other' END AS language FROM c""",
    "topical_score": f"SELECT doc_id, hits, round(CASE WHEN len(ws) > 0 THEN hits / len(ws) * 1000 ELSE 0 END, 9) AS density, hits >= 5 AND CASE WHEN len(ws) > 0 THEN hits / len(ws) * 1000 ELSE 0 END >= 3 AS topical FROM ({TOPIC_HITS})",
    "content_dedup": f"SELECT sha256({FLAT}) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "word_counts": f"SELECT doc_id, CASE WHEN {FLAT} = '' THEN 0 ELSE len(string_split({FLAT}, ' ')) END AS words, strlen(text) AS bytes FROM documents",
    "url_cases": f"SELECT id, expected AS normalized, reason FROM (VALUES {values(cases.URLS)}) x(id, url, expected, reason)",
    "url_normalize": f"""WITH u AS (SELECT page_id, url, {HOST} AS domain, {PATH} AS path, {QUERY} AS q FROM pages),
        k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')), '&') AS kq, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') AS sq FROM u)
        SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || domain || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kq = '' THEN '' ELSE '?' || kq END AS url,
          regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN sq = '' THEN '' ELSE '?' || sq END AS canonical, domain FROM k""",
    "url_denied": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'extension:.pdf' WHEN 1 THEN 'query:oldid' END AS reason FROM pages",
    "url_host_rules": "SELECT * FROM (VALUES ('a.example.com', 'domain', ''), ('b.example.net', 'prefix', '/en/ /fr/'), ('c.example.org', 'topical', '')) x(host, mode, prefixes)",
    "url_scope": f"""WITH u AS (SELECT page_id, url, {HOST} AS h, {PATH} AS p FROM pages),
        r AS (SELECT page_id, CASE WHEN h = 'spam-farm.example.org' THEN 'domain' WHEN h = 'blog.ththan.example.net' THEN CASE WHEN starts_with(p, '/en/') THEN 'prefix' ELSE 'prefix_miss' END WHEN h = 'ththed.example.org' THEN CASE WHEN page_id % 2 = 0 THEN 'topical_parent' WHEN contains(url, 'utm_source') THEN 'keyword' ELSE 'no_keyword' END ELSE 'host_not_allowed' END AS reason FROM u)
        SELECT page_id, reason IN ('domain', 'prefix', 'topical_parent', 'keyword') AS ok, reason FROM r""",
    "html_title": "SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages",
    "html_links": r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages),
        f AS (SELECT page_id, base || replace(href, '&amp;', '&') AS url, arg_min(anchor, i) AS anchor, min(i) AS i FROM a GROUP BY page_id, base || replace(href, '&amp;', '&'))
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, url, replace(replace(replace(anchor, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS anchor FROM f""",
    "fetch_pages": "SELECT url, CASE WHEN length(url) % 7 = 0 THEN 0 WHEN length(url) % 5 > 0 THEN 200 ELSE 404 END AS status_code, CASE WHEN length(url) % 7 > 0 AND length(url) % 5 > 0 THEN url END AS body, false AS truncated, CASE WHEN length(url) % 7 = 0 THEN 'TimeoutError: ' || url END AS error FROM pages",
    "robots": f"WITH u AS (SELECT page_id, {HOST} AS h, {PATH} AS p FROM pages) SELECT page_id FROM u WHERE NOT (h = 'spam-farm.example.org' AND NOT starts_with(p, '/en/') AND p <> '') AND NOT (h = 'ththed.example.org' AND starts_with(p, '/en/'))",
    "save_outcomes": saved_in_turn(f"ar AS (SELECT doc_id AS seq, 'u' || (doc_id % 700) AS url, sha256({FLAT}) AS h FROM documents)") + "SELECT seq, url, outcome FROM s WHERE i > 0",
    "save_outcomes_updates": saved_in_turn("ar AS (SELECT doc_id AS seq, 'u' || (doc_id * 7919 % 151) AS url, 'h' || (doc_id * 104729 % 83) AS h FROM documents)", "MAP {'u1': 'h1', 'u2': 'h2', 'zz': 'h3'}") + "SELECT seq, outcome FROM s WHERE i > 0",
    "known_duplicates": f"WITH d AS (SELECT doc_id, sha256({FLAT}) AS h FROM documents) SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND h IN (SELECT h FROM d WHERE doc_id % 2 = 0)",
    "upsert_labels": "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 8 WHEN doc_id % 3 = 0 THEN 7 ELSE quality END AS quality FROM labels UNION ALL SELECT doc_id + 1000000000, 7 FROM labels WHERE doc_id % 3 = 0",
    "page_decision": f"""WITH s AS ({TOPIC_HITS}), d AS (SELECT s.doc_id, hits, hits >= 5 AND CASE WHEN len(ws) > 0 THEN hits / len(ws) * 1000 ELSE 0 END >= 3 AS topical, CASE WHEN {FLAT} = '' THEN 0 ELSE len(string_split({FLAT}, ' ')) END AS n FROM s JOIN documents USING (doc_id)),
        r AS (SELECT *, CASE WHEN n < 50 THEN 'thin' WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 AND NOT topical THEN 'off_topic' END AS reason FROM d) SELECT doc_id, hits, topical, reason, reason IS NULL AS saved FROM r""",
    "domain_cap": f"WITH {TASKS} SELECT url, domain, depth, seq FROM fr WHERE place <= 100",
    "frontier_claim": f"WITH {TASKS} SELECT domain, p AS place, url FROM (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY depth, seq) AS p FROM fr) WHERE p <= 20",
    "frontier_counts": f"WITH {TASKS} SELECT domain, count(*) AS urls, count(*) AS pending FROM fr GROUP BY domain",
    "fail_islands": "WITH o AS (SELECT o_custkey % 20 AS domain, o_orderkey AS seq, o_orderstatus <> 'F' AS failed FROM orders), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY seq) AS g FROM o), r AS (SELECT domain, g, count(*) FILTER (failed) AS n FROM i GROUP BY ALL) SELECT domain, max(n) AS longest, max(n) >= 8 AS blocked FROM r GROUP BY domain",
    "fetch_outcomes": """WITH r AS (SELECT o_orderkey AS id, [200, 404, 403, 429, 503, 500, 204][o_orderkey % 7 + 1] AS code, o_orderkey % 11 = 0 AS err, o_orderkey % 5 > 0 AS body, o_orderkey % 3 + 1 AS n, CASE WHEN o_orderkey % 13 = 0 THEN 12.5 END AS ra FROM orders)
        SELECT id, CASE WHEN (err OR code IN (429, 503)) AND n >= 3 THEN 'error' WHEN err OR code IN (429, 503) THEN 'pending' WHEN code NOT BETWEEN 200 AND 299 OR NOT body THEN 'skipped' ELSE 'done' END AS new_status,
          CASE WHEN err THEN 'fetch_error' WHEN code NOT BETWEEN 200 AND 299 THEN 'http_' || code WHEN NOT body THEN 'content_type' END AS reason, NOT (err OR code IN (429, 503, 403, 500)) AS success,
          CAST(CASE WHEN (err OR code IN (429, 503)) AND n < 3 THEN coalesce(ra, least(900, 30 * pow(2, n - 1))) END AS DOUBLE) AS wait FROM r""",
    "stale_pages": "SELECT event_id FROM events WHERE (SELECT max(ts) FROM events) - ts >= INTERVAL 7 DAY",
    "log_recovery": "SELECT * FROM (VALUES ('https://a.example.org/1', 2), ('https://b.example.org/3', -1)) x(url, depth)",
    "metrics_runs": f"WITH {RUNS} SELECT run_id, R, p5, pk, ap, r_precision, fk, rr, ndcg, coverage, novelty FROM m",
    "metrics_summary": f"WITH {RUNS} SELECT CASE WHEN grouping(index_name) = 0 THEN 'index' WHEN grouping(need) = 0 THEN 'need' WHEN grouping(judge) = 0 THEN 'judge' ELSE 'all' END AS kind, coalesce(index_name, need, judge, '') AS key, count(*) AS runs, {MEANS} FROM m GROUP BY GROUPING SETS ((), (index_name), (need), (judge))",
    "metrics_pool": f"WITH {RUNS} SELECT * FROM pool",
    "pk_curve": f"WITH {RUNS} SELECT index_name, k, round(sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / k / count(DISTINCT run_id), 9) AS precision FROM l, range(1, 11) x(k) GROUP BY index_name, k",
    "interp_precision": f"WITH {RUNS}, pt AS (SELECT run_id, index_name, hits / rank AS p, hits / R AS rc FROM h JOIN rel USING (need) WHERE R > 0), lv AS (SELECT run_id, index_name, level, coalesce(max(p) FILTER (rc >= level / 10), 0) AS p FROM pt, range(0, 11) x(level) GROUP BY ALL) SELECT index_name, level, round(avg(p), 9) AS precision FROM lv GROUP BY ALL",
    "kappa": f"""WITH {RUNS}, lm AS (SELECT need, page_id, judge, CASE WHEN arg_max(relevance, run_id) >= 1 THEN 1 ELSE 0 END AS hit FROM j JOIN runs USING (run_id) GROUP BY ALL),
        s AS (SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS pairs, avg(CASE WHEN a.hit = b.hit THEN 1 ELSE 0 END) AS po, avg(a.hit) * avg(b.hit) + (1 - avg(a.hit)) * (1 - avg(b.hit)) AS pe FROM lm a JOIN lm b ON a.need = b.need AND a.page_id = b.page_id AND a.judge < b.judge GROUP BY ALL)
        SELECT judge_a, judge_b, pairs, round(CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 9) + 0.0 AS kappa FROM s""",
    "feedback_pages": f"WITH {RUNS} SELECT page_id, max(relevance) >= 1 AS relevant FROM j JOIN runs USING (run_id) WHERE query = 'query 3' GROUP BY page_id",
    "grade_counts": f"WITH {RUNS} SELECT relevance, count(*) AS judgements FROM j GROUP BY relevance",
    "usage_latency": f"WITH {LOG_Q} SELECT queries, sessions, without_results, ms_mean, ms_p50, ms_p95, with_feedback, with_suggestion, round(without_results / queries, 9) AS without_share, clicks, round(clicked / queries, 9) AS ctr FROM (SELECT count(*) AS queries, count(DISTINCT session) AS sessions, count(*) FILTER (total = 0) AS without_results, round(avg(ms), 6) AS ms_mean, round(quantile_cont(ms, 0.5), 6) AS ms_p50, round(quantile_cont(ms, 0.95), 6) AS ms_p95, count(*) FILTER (rocchio) AS with_feedback, count(*) FILTER (suggested) AS with_suggestion FROM q), (SELECT count(*) AS clicks, count(DISTINCT query_id) AS clicked FROM c)",
    "usage_by_day": f"WITH {LOG_Q} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS queries, count(DISTINCT session) AS sessions FROM q GROUP BY 1",
    "usage_ctr": f"WITH {LOG_Q} SELECT rank, count(*) AS clicks FROM c GROUP BY rank",
    "usage_top_queries": f"WITH {LOG_Q} SELECT query, count(*) AS times FROM q GROUP BY query ORDER BY times DESC, query LIMIT 15",
    "stream_total": "SELECT event_type AS source, count(*) AS pages, CAST(sum(user_id) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "stream_windows": "WITH w AS (SELECT event_type AS source, user_id, CAST(CAST(ts AS DATE) - CAST(o AS INTEGER) AS DATE) AS start FROM events, range(0, 2) x(o)) SELECT strftime(start, '%Y-%m-%d') AS start, source, count(*) AS pages, CAST(sum(user_id) AS BIGINT) AS bytes FROM w GROUP BY ALL",
    "stream_once": "SELECT DISTINCT 'u' || user_id AS url FROM events",
    "seed_rows": "SELECT * FROM (VALUES ('s1', 'https://a.example.com/wiki/', 'domain'), ('s4', 'https://c.example.org/', 'topical'), ('s5', 'https://c.example.org/x', 'bogus')) x(seed_id, url, scope_mode)",
    "seed_tasks": "SELECT *, 0 AS depth, true AS parent_topical FROM (VALUES ('s1', 'https://a.example.com/wiki/'), ('s2', 'https://b.example.net/en/'), ('s3', 'https://b.example.net/fr/'), ('s4', 'https://c.example.org/'), ('s5', 'https://c.example.org/x')) x(seed_id, url)",
    "redirect_rules": "SELECT * FROM (VALUES ('a.org', 'prefix', '/x'), ('b.org', 'prefix', '/x /y'), ('c.org', 'prefix', '/x')) x(host, mode, prefixes)",
    "robots_parsed": "SELECT * FROM (VALUES ('s', '/a', 'false', 0.0), ('s', '/a/b', 'true', 0.0), ('s', '', '', 2.5)) x(site, path, allow, delay)",
    "retry_headers": "SELECT id, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES (1, 12), (2, 60), (3, 0), (4, -1)) x(id, seconds)",
    "resume_requests": """WITH p AS (SELECT 'u' || user_id AS url, ts, event_id % 4 AS depth, event_type AS src, 200 + event_id % 3 * 100 AS code, props FROM events), r AS (SELECT DISTINCT url, length(url) - 2 AS depth, url LIKE '%7' AS forced FROM p)
        SELECT url, depth FROM r WHERE forced OR NOT EXISTS (SELECT 1 FROM p WHERE p.url = r.url AND src = 'click' AND code BETWEEN 200 AND 299 AND props IS NOT NULL AND (SELECT max(ts) FROM p) - ts <= INTERVAL 1 DAY AND r.depth >= p.depth)""",
    "frontier_revisit": "WITH l AS (SELECT 'u' || user_id AS url, max(ts) AS ts FROM events GROUP BY 1) SELECT CASE WHEN url LIKE '%3' THEN 'skipped' WHEN (SELECT max(ts) FROM l) - ts >= INTERVAL 12 HOUR THEN 'pending' ELSE 'done' END AS status, count(*) AS urls FROM l GROUP BY 1",
    "frontier_blocked": f"""WITH {TASKS}, e AS (SELECT 'h' || (o_custkey % 50) || '.example.org' AS domain, o_orderkey AS seq, o_orderstatus <> 'F' AS failed FROM orders), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY seq) AS g FROM e),
        b AS (SELECT DISTINCT domain FROM (SELECT domain, g, count(*) FILTER (failed) AS n FROM i GROUP BY ALL) WHERE n >= 9) SELECT CASE WHEN domain IN (SELECT domain FROM b) THEN 'skipped' ELSE 'pending' END AS status, count(*) AS urls FROM fr GROUP BY 1""",
    "frontier_marked": f"WITH {TASKS} SELECT CASE depth WHEN 1 THEN 'done' WHEN 2 THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN depth = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN depth < 3 THEN 'r' || depth ELSE '' END AS reason, count(*) AS urls FROM fr GROUP BY ALL",
    "links_kept": r"""WITH a AS (SELECT page_id, url AS from_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), f AS (SELECT DISTINCT page_id, from_url, base || replace(href, '&amp;', '&') AS to_url FROM a) SELECT from_url, to_url FROM f WHERE contains(to_url, '/en')""",
    "text_paths": rf"""SELECT page_id, 'own/' || {HOST} || '/' || left(h, 2) || '/' || left(h, 16) || '.txt' AS path FROM (SELECT page_id, url, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS h FROM pages)""",
    "valid_judgements": f"WITH {RUNS} SELECT run_id, page_id, relevance FROM j JOIN shown USING (run_id, page_id)",
    "coverage_novelty": f"WITH {RUNS} SELECT run_id, judge, need, coalesce(coverage, -1) AS coverage, coalesce(novelty, -1) AS novelty FROM cn JOIN runs USING (run_id)",
    "search_page_site": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY page_id) AS rank, page_id AS doc_id, 0.0 AS score FROM pages WHERE ({HOST} = 'example.org' OR {HOST} LIKE '%.example.org') AND {HOST} NOT LIKE '%spam-farm.example.org') WHERE rank <= 20",
    "edit_candidates": "SELECT word, n * 35 + (n + 1) * 36 - n + n + (n - 1) + 1 - CASE WHEN n = 1 THEN 0 ELSE 0 END AS candidates FROM (SELECT word, length(word) AS n FROM (VALUES ('ab'), ('x'), ('zelda')) x(word))",
    "stream_rates": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS start, count(*) AS pages, CAST(sum(user_id) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "vocab_difference": f"WITH {TOKENS} SELECT DISTINCT term, 'only_a' AS status FROM p WHERE term IN ({listed(STOP_WORDS)})",
    "index_report": f"""WITH {TOKENS}, d AS (SELECT count(*) AS docs, count(*) FILTER (text IS NULL) AS missing, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS text_bytes FROM documents)
        SELECT 'basico' AS policy, docs, missing, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, count(*) AS postings, text_bytes, round(sum(tf) / docs, 6) AS length_mean, true AS sized FROM p, d GROUP BY docs, missing, text_bytes""",
    "index_plots": f"WITH {TOKENS} SELECT 'basico' AS policy, 'terms' AS measure, CAST(count(DISTINCT term) AS DOUBLE) AS value FROM p",
    "doc_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc FROM documents WHERE doc_id % 3 > 0",
    "suggest": f"WITH {INDEX}, {ASKED} {SUGGESTED} SELECT word, suggestion, df FROM sg",
    "suggest_queries": f"""WITH {INDEX}, tx AS (SELECT * FROM (VALUES ('stupidd trsah'), ('the stupid trash'), ('-stupidd site:trsah worthles'), ('qqqqqqqq'), ('Thee +trsah')) x(text)),
        tw AS (SELECT text, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM tx), aw AS (SELECT DISTINCT word FROM tw WHERE NOT contains(word, ':') AND left(word, 1) NOT IN ('+', '-')) {SUGGESTED}
        SELECT text, CASE WHEN count(suggestion) > 0 THEN string_agg(coalesce(suggestion, word), ' ' ORDER BY i) END AS suggestion FROM tw LEFT JOIN sg USING (word) GROUP BY text""",
    "search_page": cosine(words("stupid", "trash"), k=20).replace(
        "SELECT rank, doc_id, score FROM r WHERE rank <= 20",
        """SELECT rank, doc_id, score, CASE WHEN doc_id % 3 > 0 THEN 'No. ' || doc_id ELSE 'https://' || source || '.Example.org/' || doc_id END AS title, 'https://' || source || '.Example.org/' || doc_id AS url, source || '.example.org' AS domain, lang AS language,
          (SELECT count(*) FROM r) AS total, (SELECT CAST(ceil(count(*) / 10) AS BIGINT) FROM r) AS pages, 'zzzznowhere' AS unknown, CAST(NULL AS VARCHAR) AS suggestion, CAST(NULL AS VARCHAR) AS notice FROM r JOIN documents USING (doc_id) WHERE rank > 10 AND rank <= 20""",
    ),
    "search_glued_quotes": cosine(words("stupid", "trash")),
    "journal_run": cosine(words("stupid", "trash")).replace("SELECT rank, doc_id, score FROM r", "SELECT rank, doc_id AS page_id, score, CASE rank WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS relevance, 1 AS queries, 1 AS clicks FROM r"),
    "corpus_report": f"""WITH {LETTERS}, d AS (SELECT source, lang, 'd' || (doc_id % 30) AS domain, len(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) AS w, strlen(coalesce(text, '')) AS b FROM documents),
        dm AS (SELECT 'domain' AS part, domain AS key, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, CAST(sum(b) AS BIGINT) AS bytes FROM d GROUP BY domain ORDER BY bytes DESC, domain LIMIT 20),
        w1 AS (SELECT 'word' AS part, word AS key, 0 AS docs, freq AS words, 0 AS bytes FROM f ORDER BY freq DESC, word LIMIT 50),
        w2 AS (SELECT 'plain_word' AS part, word AS key, 0 AS docs, freq AS words, 0 AS bytes FROM f WHERE length(word) >= 3 AND word NOT IN ({listed(REPORT_STOP_WORDS)}) ORDER BY freq DESC, word LIMIT 50)
        SELECT 'all' AS part, 'all' AS key, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, CAST(sum(b) AS BIGINT) AS bytes FROM d UNION ALL SELECT 'source', source, count(*), sum(w), sum(b) FROM d GROUP BY source UNION ALL SELECT 'language', lang, count(*), sum(w), sum(b) FROM d GROUP BY lang
        UNION ALL SELECT * FROM dm UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2""",
    "crawled_pages": "SELECT 'custom' AS crawler_source, count(*) AS pages, 0 AS with_url, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'scrapy', count(*), count(url), CAST(sum(strlen(html)) AS BIGINT) FROM pages",
    "topical_default": "SELECT doc_id, CASE doc_id % 9 WHEN 8 THEN 0 WHEN 7 THEN 12 ELSE 6 END AS hits, doc_id % 9 < 8 AS topical FROM documents",
    "url_domain_port": "SELECT page_id, 'user@' || regexp_extract(url, '://([^/?#]*)', 1) || ':8080' || CASE WHEN regexp_extract(url, '://[^/?#]*([?#][^/]*)', 1) <> '' THEN regexp_extract(url, '://[^/?#]*([?#][^/]*)', 1) ELSE '' END AS domain FROM pages",
    "url_scope_default": "SELECT page_id, page_id % 6 NOT IN (3, 5, 2) AS ok, CASE WHEN page_id % 6 IN (3, 5, 2) THEN 'no_keyword' ELSE 'keyword' END AS reason FROM pages",
    "fetch_cut": "SELECT url, least(5000000, 4999999 + length(url) % 3) AS chars, length(url) % 3 = 2 AS truncated FROM pages WHERE page_id < 12",
    "hard_failures": "WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN [200, 404, 403, 429, 503, 500, 204][o_orderkey % 7 + 1] END AS code FROM orders) SELECT id, id % 11 = 0 OR code IS NULL OR code IN (403, 429) OR code >= 500 AS failed FROM r",
    "frontier_reset": "WITH o AS (SELECT o_orderkey % 4 AS s FROM orders) SELECT CASE s WHEN 2 THEN 'done' WHEN 3 THEN 'error' ELSE 'pending' END AS status, count(*) AS urls FROM o GROUP BY 1",
    "recovery_pages": f"""WITH u AS (SELECT page_id, url, page_id % 8 AS depth, {HOST} AS h, {PATH} AS p FROM pages) SELECT page_id, CAST(depth AS INT) AS depth FROM u WHERE url IN (SELECT url FROM u WHERE page_id % 5 > 0) AND depth > 0 AND depth < 6
        AND (h IN ('spam-farm.example.org', 'ththed.example.org') OR h = 'blog.ththan.example.net' AND starts_with(p, '/en/'))""",
    "seeds_saved": "SELECT 's' || s_suppkey AS seed_id, CASE WHEN s_suppkey % 6 = 0 THEN 'newer' WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS url FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0",
    "runs_table": f"""WITH {RUNS}, jd AS (SELECT run_id, count(*) AS judged FROM j GROUP BY run_id), rl AS (SELECT run_id, CAST(sum(hit) AS BIGINT) AS relevant FROM l GROUP BY run_id)
        SELECT run_id, judge, CASE WHEN run_id % 10 = 0 THEN '' ELSE m.need END AS need, 'Query ' || (run_id % 5) AS query, index_name, '2026-01-01' AS ts, judged, relevant, p5, pk AS p10, ap, rr, ndcg AS ndcg10, CAST(run_id * 1.5 AS DOUBLE) AS ms FROM m JOIN jd USING (run_id) JOIN rl USING (run_id)""",
    "snippet": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(left(text, 200000), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE contains(text, 'All rights reserved')),
        h AS (SELECT *, len(ws) AS n, list_transform(ws, lambda x: CASE WHEN list_has_any(regexp_extract_all(lower(replace(strip_accents(x), 'ß', 'ss')), '[\p{L}\p{N}]+'), ['rights', 'reserved']) THEN 1 ELSE 0 END) AS hs FROM w),
        c AS (SELECT *, CASE WHEN n < 32 THEN hs ELSE list_transform(range(1, n - 30), lambda i: list_sum(hs[i:i + 31])) END AS cs FROM h),
        a AS (SELECT *, list_position(cs, list_max(cs)) - 1 AS a0 FROM c),
        m AS (SELECT doc_id, n, a0, list_transform(range(a0 + 1, least(a0 + 32, n) + 1), lambda i: CASE WHEN hs[i] = 1 THEN '<mark>' || replace(replace(replace(replace(ws[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</mark>' ELSE replace(replace(replace(replace(ws[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END) AS ms FROM a)
        SELECT doc_id, CASE WHEN a0 > 0 THEN '… ' ELSE '' END || array_to_string(ms, ' ') || CASE WHEN a0 + 32 < n THEN ' …' ELSE '' END AS snippet FROM m""",
}
SQL["search_page_feedback"] = SQL["search_rocchio"]
