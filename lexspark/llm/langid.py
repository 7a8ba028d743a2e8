"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text's likelihood under hashed byte
trigram models, the language its markup declares, its address suffix, and a prior of its
host. Host priors are smoothed hierarchically: a host leans on its suffix, a suffix on
the whole table, by grouped aggregation of the texts' own posteriors, each row's own
part left out. How far declarations can be trusted is estimated the same way.

An extra class, ``und``, has a flat likelihood: texts without letters, or unlike every
trained language, fall to it and are rejected. Nothing but the text decides that.

Scale. One pass over the texts; then rows of a few numbers. Counts by host and by
suffix are partial aggregates; rows meet them in plain shuffled joins of written tables, which
adaptive execution splits if one host or suffix holds a third of all rows. Text models are fitted on about
``per_language`` labelled texts of each language, and every label has its model: models,
and the numbers kept for each row, grow with the number of labels.

Defined results: null and empty texts are ``und`` and rejected; where no text is labelled,
all are ``und`` and those with letters are accepted; a missing host, suffix
or declaration is no evidence; ties go to the language first in alphabetical order;
repeated rows give repeated results (and count each for the priors); other columns are
carried by the caller; an empty table gives an empty result; texts of any length are read
whole, pages in time linear in their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.layout import spread
from lexspark.llm.markup import plain_text
from lexspark.storage import kept
from lexspark.llm.words import GRAM, LOWER, DocBatch, sliced

UNKNOWN = "und"
BUCKETS = 1 << 15
LETTERS = (np.arange(256) >= 0x80) | np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Nats of a trigram under the flat class; of those in a language's own texts, most have fewer.
FLAT = -float(np.log(BUCKETS))
#: Share of a language's model that is flat, for trigrams its sample didn't hold.
SMOOTHING = 0.2
#: A text counts as at most this many independent trigrams.
INDEPENDENT = 40.0
HOST_WEIGHT = 4.0
SUFFIX_WEIGHT = 20.0
#: Numbers held at once for the languages of rows.
CELLS = 1 << 20


def trigrams(batch: DocBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram that holds letters only or one edge of a word, and its text."""
    d = LOWER[batch.data]
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = LETTERS[d]
    d = np.where(letter, d, np.uint8(32)).astype(np.uint64)
    at = np.flatnonzero(letter[1:-1] & (letter[:-2] | letter[2:]))
    doc = np.searchsorted(batch.offsets, at, "right") - 1
    inside = at + 3 <= batch.offsets[doc + 1]
    at, doc = at[inside], doc[inside]
    code = (d[at] << np.uint64(16)) | (d[at + 1] << np.uint64(8)) | d[at + 2]
    return ((code * GRAM) >> np.uint64(49)).astype(np.int64), doc


def narrow(batches, size: int):
    """The same rows in slices of at most CELLS numbers, at ``size`` a row."""
    step = max(1, CELLS // size)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sample_of(df: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """About per_language rows (text, lang) of each language in counts: drawn by doc_id and text, so that copies of a text are drawn singly; by text where df has no doc_id."""
    limits = df.sparkSession.createDataFrame([(k, round(1e6 * min(1.0, per_language / n))) for k, n in counts.items()], "lang string, most long")
    drawn = F.xxhash64(*(c for c in ("doc_id", "text") if c in df.columns))
    return df.join(F.broadcast(limits), "lang").where(F.pmod(drawn, F.lit(1_000_000)) < F.col("most")).select("lang", "text")


def train_texts(df: DataFrame, per_language: int = 3000, least: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of trigrams, from rows (text, lang, and doc_id where there is one) of which about per_language of each are read.

    Every label is modelled; counts by language and bucket are one aggregate.
    """
    seen = df.where("lang IS NOT NULL AND length(text) > 0").groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in seen if r["count"] >= least and r["lang"] != UNKNOWN}
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, BUCKETS))
    number = {x: i for i, x in enumerate(names)}
    sample = sample_of(df, counts, per_language)

    def run(batches):
        for part in sliced(batches):
            if part.num_rows:
                bucket, doc = trigrams(DocBatch.of(part.column("text")))
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                key, n = np.unique(lang[doc] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    counted = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(names) * BUCKETS)
    total[counted.column("key").to_numpy()] = counted.column("n").to_numpy()
    total = total.reshape(len(names), BUCKETS)
    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1)
    return names, np.log((1 - SMOOTHING) * share + SMOOTHING / BUCKETS)


def evidence(df: DataFrame, names: list[str], model: np.ndarray, markup: bool) -> DataFrame:
    """Add to rows (row key columns, text, declared) the texts' log-likelihoods per language; ``markup``: text is HTML."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in df.columns if c not in ("text", "declared")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried) + ", declared string, n_trigrams long, likelihood array<double>, own array<double>"

    def run(batches):
        for part in narrow(sliced(batches), len(names) + 1):
            texts, declared = part.column("text"), part.column("declared")
            if markup:
                read = [plain_text(t or "") for t in texts.to_pylist()]
                texts, declared = (pa.array(list(x), pa.string()) for x in zip(*read, strict=True))
            batch = DocBatch.of(texts)
            bucket, doc = trigrams(batch)
            n = np.bincount(doc, minlength=batch.n_docs)
            mean = np.full((batch.n_docs, len(names) + 1), FLAT)
            for i in range(len(names)):
                mean[:, i] = np.bincount(doc, weights=shared.value[i][bucket], minlength=batch.n_docs) / np.maximum(n, 1)
            mean[n == 0, :-1] = FLAT - 1
            score = mean * np.minimum(np.maximum(n, 1), INDEPENDENT)[:, None]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (score, p)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), declared, pa.array(n.astype(np.int64)), *lists], [*carried, "declared", "n_trigrams", "likelihood", "own"])

    return spread(df.select(*carried, "text", "declared")).mapInArrow(run, schema)


def _sum(column: str, size: int, weight: Column | None = None) -> Column:
    return F.array(*(F.sum(F.col(column)[i] if weight is None else F.col(column)[i] * weight) for i in range(size)))


def fuse(df: DataFrame, names: list[str], min_confidence: float = 0.5) -> DataFrame:
    """Posterior from rows of evidence() with columns ``host`` and ``suffix``: adds lang, confidence, text_lang, accepted.

    A row is accepted if by its text alone all languages together have at least ``min_confidence``
    against ``und``; its language is then the likeliest by all evidence, however close others come.
    """
    size = len(names) + 1
    table = kept(df, "evidence")
    host = kept(table.where("host IS NOT NULL").groupBy("host").agg(_sum("own", size).alias("host_sum")), "hosts")
    suffix = kept(table.where("suffix IS NOT NULL").groupBy("suffix").agg(_sum("own", size).alias("suffix_sum")), "suffixes")
    total = np.array(table.agg(_sum("own", size).alias("s")).first()["s"] or [0.0] * size, float)
    known = {n: i for i, n in enumerate(names)}
    trust = np.ones((size, size + 1))  # row: language of the text; column: what is declared, the last: something else
    for r in table.where(F.col("declared").isNotNull()).groupBy(F.when(F.col("declared").isin(names), F.col("declared")).alias("d")).agg(_sum("own", size).alias("s")).collect():
        trust[:, known.get(r["d"], size)] += np.array(r["s"])
    trust /= trust.sum(axis=1, keepdims=True)
    shared = df.sparkSession.sparkContext.broadcast((total, trust))
    carried = [c for c in df.columns if c not in ("likelihood", "own")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried) + ", lang string, confidence double, text_lang string, accepted boolean"
    labels = np.array([*names, UNKNOWN])

    def run(batches):
        total, trust = shared.value
        flat = (total + 1) / (total + 1).sum()
        for part in narrow(batches, size):
            own = np.array(part.column("own").to_pylist(), float).reshape(-1, size)
            score = np.array(part.column("likelihood").to_pylist(), float).reshape(-1, size)
            text_lang = labels[score.argmax(axis=1)]
            rows = list(zip(part.column("suffix_sum").to_pylist(), part.column("host_sum").to_pylist(), strict=True))
            below = np.array([np.zeros(size) if s is None else s for s, _ in rows]) - own * np.array([s is not None for s, _ in rows])[:, None]
            prior = np.maximum(below, 0) + SUFFIX_WEIGHT * flat
            prior /= prior.sum(axis=1, keepdims=True)
            near = np.array([np.zeros(size) if h is None else h for _, h in rows], float) - own * np.array([h is not None for _, h in rows])[:, None]
            prior = np.maximum(near, 0) + HOST_WEIGHT * prior
            prior /= prior.sum(axis=1, keepdims=True)
            said = [known.get(d, size) if d is not None else -1 for d in part.column("declared").to_pylist()]
            score = score + np.log(prior) + np.array([np.log(trust[:, d]) if d >= 0 else np.zeros(size) for d in said])
            n = part.column("n_trigrams").to_numpy()
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            ok = (n > 0) & (own[:, :-1].sum(axis=1) >= min_confidence) if names else n > 0
            best = np.where(ok, p[:, :-1].argmax(axis=1), size - 1) if names else np.zeros(len(p), np.int64)
            confidence = p[np.arange(len(p)), best]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(labels[best].tolist(), pa.string()), pa.array(confidence), pa.array(text_lang.tolist(), pa.string()), pa.array(ok)], [*carried, "lang", "confidence", "text_lang", "accepted"])

    return table.join(host, "host", "left").join(suffix, "suffix", "left").select(*df.columns, "host_sum", "suffix_sum").mapInArrow(run, schema)


def address(url: Column) -> tuple[Column, Column]:
    """Host and suffix of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host != "", host)
    suffix = F.regexp_extract(host, r"\.([a-z]{2,24})$", 1)
    return host, F.when(suffix != "", suffix)


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): lang, confidence, what was declared and what the text alone says."""
    names, model = train_texts(labelled.select(*(c for c in ("doc_id", "text", "lang") if c in labelled.columns)))
    host, suffix = address(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), suffix.alias("suffix"), F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"))
    return fuse(evidence(rows, names, model, markup=True), names).drop("suffix")


def document_languages(docs: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text, lang, source): the columns of page_languages, by doc_id and k (hash of the row's text); the source stands for the host."""
    names, model = train_texts(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), F.coalesce("text", F.lit("")).alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"))
    return fuse(evidence(rows, names, model, markup=False), names).drop("suffix")
