"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is held against all documents before it. The reference is indexed by blocks
cut where the content says: each window of ``window`` words belongs to the least hash among
its short n-grams (its anchor), and a maximal run of windows with one anchor is a block, so equal
passages are cut into equal blocks wherever they stand. The index names for each distinct
block, and for each window of blocks whose anchor stands in several surroundings, the
earliest document that has it and the place there.

A document is parsed greedily, from left to right, into factors: from a window that the index
knows, the match goes on for as long as the next window is the next one at that place of the
earlier document, through as many blocks as it lasts. A block that occurs whole is looked up as
one. Where a factor ends, the parse goes on at the next window, not after the factor's last word:
so the windows across its boundary are looked up too, and every window that occurs earlier
lies in some factor. Factors are at least ``window`` words long; they are the duplicate spans.
Windows repeated inside one document are found in that document.

The index holds one place for a window, the earliest, so a factor is the longest match at
that place; a later document may hold a longer one, which the next factor then covers.

Scale. The first pass writes one 8-byte hash for about eight words once, and shuffles it, to count
in how many documents it occurs; only documents with such a hash go on with their text. Minima
over documents are partial aggregates, and rows meet them in plain shuffled joins that
adaptive execution splits, so a passage in a third of all documents is no hot task.

Defined results: a null text has no words; equal hashes are 128 bits for windows; rows of
equal ``doc_id`` are never earlier than each other; a missing ``doc_id`` is before all
others; doc_id is an integer; columns other than ``doc_id`` and ``text`` are not read; an empty
table gives an empty result; texts of any length are parsed whole. Of several places in the
earliest document any one is named.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.storage import drop, kept
from lexspark.llm.words import GRAM, SLICE_BYTES, DocBatch, later, map_texts, mix, sliced, within

ANCHOR = 6
FIRST = -(2**63)


def window_minima(batch: DocBatch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and the least n-gram hash in it."""
    at, grams = batch.grams(min(ANCHOR, window))
    total = len(batch.word_hashes)
    low = np.full(total, np.uint64(2**64 - 1), np.uint64)
    low[at] = grams
    width, have = window - min(ANCHOR, window) + 1, 1
    while have < width:
        step = min(have, width - have)
        left = max(total - step, 0)
        low[:left] = np.minimum(low[:left], low[step:])
        have += step
    room = np.repeat(batch.word_offsets[1:], batch.n_words) - np.arange(total)
    starts = np.flatnonzero(room >= window)
    return starts, low[starts]


def anchors(df: DataFrame, window: int) -> DataFrame:
    """(anchor, k): each least hash once a document."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        batch = DocBatch.of(part.column("text"))
        starts, low = window_minima(batch, window)
        doc = batch.doc_of_word[starts]
        run = np.ones(len(low), bool)
        run[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        low, doc = low[run], doc[run]
        first = ~later(within(low, doc))
        k = part.column("k").take(pa.array(doc[first]))
        return pa.RecordBatch.from_arrays([pa.array(low[first].view(np.int64)), k], ["anchor", "k"])

    return map_texts(df.select("k", "text"), one, "anchor long, k long")


def _runs(mask_or_keys: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(mask_or_keys), bool)
    new[1:] = mask_or_keys[1:] != mask_or_keys[:-1]
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def columns_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def shrunk(df: DataFrame, carried: list[str]) -> DataFrame:
    """The rows with their text as compressed bytes: what the joins below move."""
    own = ["doc_id", "d", "k", *carried]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        body = pa.array([None if t is None else pack.compress(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in own), body], [*own, "body"])

    return map_texts(df.select(*own, "text"), one, columns_of(df, own) + ", body binary")


def texts_of(bodies: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if b is None else unpack.decompress(b) for b in bodies.to_pylist()], pa.binary()).cast(pa.string())


BLOCK = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("windows", pa.binary())])
SPAN = pa.struct([("start", pa.int32()), ("n", pa.int32())])
PARSED = "n_words long, body binary, sha string, own array<struct<start:int,n:int>>, blocks array<struct<start:int,n:int,anchor:bigint,content:bigint,windows:binary>>"


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def parse(df: DataFrame, window: int, carried: list[str], with_text: bool) -> DataFrame:
    """Blocks of each document that may occur in others, windows it repeats itself, and for documents with neither the result."""
    keys = ["doc_id", "d", "k", *carried]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        bodies = part.column("body")
        texts = texts_of(bodies)
        batch = DocBatch.of(texts)
        starts, low = window_minima(batch, window)
        _, windows = batch.grams(window)
        doc = batch.doc_of_word[starts]
        place = starts - batch.word_offsets[doc]
        shared = np.zeros(len(starts), bool)
        some = np.unique(doc)
        cuts = np.searchsorted(doc, np.append(some, batch.n_docs))
        for d, a, b in zip(some, cuts, cuts[1:], strict=False):
            hits = part.column("hits")[int(d)].values
            if hits is not None:
                shared[a:b] = np.isin(low[a:b].view(np.int64), hits.to_numpy(zero_copy_only=False))
        own = later(within(windows, doc))
        open_ = np.zeros(batch.n_docs, bool)
        open_[doc[shared | own]] = True

        o = np.flatnonzero(own)
        o_start = _runs(place[o] - np.arange(len(o)), doc[o])
        own_spans = pa.StructArray.from_arrays([pa.array(place[o][o_start], pa.int32()), pa.array(np.diff(np.append(o_start, len(o))), pa.int32())], fields=list(SPAN))
        own_list = _lists(np.bincount(doc[o][o_start], minlength=batch.n_docs), own_spans)

        s = np.flatnonzero(shared)
        s_start = _runs(low[s], doc[s], place[s] - np.arange(len(s)))
        n = np.diff(np.append(s_start, len(s)))
        w = windows[s]
        step = np.arange(len(s)) - np.repeat(s_start, n)
        content = np.add.reduceat(mix(w + step.astype(np.uint64) * GRAM), s_start) if len(s) else w
        raw = w.astype("<u8").tobytes()
        fields = [pa.array(place[s][s_start], pa.int32()), pa.array(n, pa.int32()), pa.array(low[s][s_start].view(np.int64)), pa.array(content.view(np.int64)), pa.array([raw[8 * a : 8 * (a + m)] for a, m in zip(s_start, n, strict=True)], pa.binary())]
        block_list = _lists(np.bincount(doc[s][s_start], minlength=batch.n_docs), pa.StructArray.from_arrays(fields, fields=list(BLOCK)))

        sha = [None if o else digest(t, None)[1] for t, o in zip(texts.to_pylist(), open_, strict=True)]
        left = [b if o or with_text else None for b, o in zip(bodies.to_pylist(), open_, strict=True)]
        found = [pa.array(batch.n_words), pa.array(left, pa.binary()), pa.array(sha, pa.string()), own_list, block_list]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *found], [*keys, "n_words", "body", "sha", "own", "blocks"])

    def run(batches):
        for part in sliced(batches, "body", SLICE_BYTES // 2):
            if part.num_rows:
                yield one(part)

    return df.select(*keys, "body", "hits").mapInArrow(run, columns_of(df, keys) + ", " + PARSED)


#: Python's own split() would cut at more characters than the six that part words here.
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode().translate(_SPACES).split(b" ") if w]


def digest(text: str | None, removed: np.ndarray | None) -> tuple[str, str]:
    """The kept words joined by spaces, and their SHA-256."""
    words = words_of(text)
    if removed is not None:
        words = [w for w, gone in zip(words, removed, strict=True) if not gone]
    joined = b" ".join(words)
    return joined.decode(), hashlib.sha256(joined).hexdigest()


def finish(df: DataFrame, window: int, carried: list[str], with_text: bool) -> DataFrame:
    """Remove what the factors cover; a text that loses nothing stays as it is, any other is its words joined by spaces."""
    keys = ["doc_id", *carried]

    def run(batches):
        for part in sliced(batches, "body", SLICE_BYTES):
            removed, sha, text = [], [], []
            for t, n, own, spans_ in zip(texts_of(part.column("body")), part.column("n_words"), part.column("own"), part.column("spans"), strict=True):
                step = np.zeros(n.as_py() + 1, np.int64)
                parts = [tuple(own.values.field(c).to_numpy() for c in ("start", "n"))] if own.is_valid and len(own) else []
                if spans_.is_valid and len(spans_):
                    found = factors(*(spans_.values.field(c).to_numpy() for c in ("start", "n", "source", "place")))
                    parts.append((found[:, 0], found[:, 1]))
                for a, m in parts:
                    np.add.at(step, a, 1)
                    np.add.at(step, a + m + window - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                left, hashed = digest(t.as_py(), gone)
                removed.append(int(gone.sum()))
                sha.append(hashed)
                text.append((left if gone.any() else t.as_py()) if with_text else None)
            found = [part.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *found], [*keys, *RESULT])

    return df.select(*keys, "n_words", "body", "own", "spans").mapInArrow(run, columns_of(df, keys) + ", n_words long, n_removed long, kept_sha256 string, kept_text string")


RESULT = ["n_words", "n_removed", "kept_sha256", "kept_text"]


def untouched(df: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of documents that lose nothing, with their text where it was kept."""
    keys = ["doc_id", *carried]

    def run(batches):
        for part in sliced(batches, "body", SLICE_BYTES):
            found = [part.column("n_words"), pa.array(np.zeros(part.num_rows, np.int64)), part.column("sha"), texts_of(part.column("body"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *found], [*keys, *RESULT])

    return df.select(*keys, "n_words", "sha", "body").mapInArrow(run, columns_of(df, keys) + ", n_words long, n_removed long, kept_sha256 string, kept_text string")


def split_windows(df: DataFrame) -> DataFrame:
    """One row a window of blocks (d, k, start, anchor, windows)."""

    def run(batches):
        for part in batches:
            raw = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column("windows")]
            n = np.array([len(x) for x in raw], np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = part.column("start").to_numpy()[at.to_numpy()] + step
            yield pa.RecordBatch.from_arrays([part.column("d").take(at), part.column("k").take(at), pa.array(place, pa.int32()), part.column("anchor").take(at), pa.array(np.concatenate(raw) if raw else np.zeros(0, np.int64), pa.int64())], ["d", "k", "start", "anchor", "w"])

    return df.select("d", "k", "start", "anchor", "windows").mapInArrow(run, "d long, k long, start int, anchor long, w long")


def matches(parsed: DataFrame) -> DataFrame:
    """(d, k, spans): for each document, the runs of windows (start, n) that the index knows from an earlier document (source, place)."""
    blocks = parsed.select("d", "k", F.inline("blocks"))
    earliest = (F.min("d").alias("source"), F.min_by("start", "d").alias("place"))
    sources = kept(blocks.groupBy("anchor", "content").agg(*earliest), "sources")
    contexts = kept(sources.groupBy("anchor").count().where("count > 1").select("anchor"), "contexts")
    placed = blocks.join(sources, ["anchor", "content"])
    whole = placed.where("source < d").select("d", "k", "start", "n", "source", "place")
    edges = placed.where("source = d").select("d", "k", "start", "anchor", "windows").join(contexts, "anchor", "left_semi")
    windows = kept(split_windows(edges), "windows")
    first = kept(windows.groupBy("anchor", "w").agg(*earliest), "first")
    single = windows.join(first, ["anchor", "w"]).where("source < d").select("d", "k", "start", F.lit(1).alias("n"), "source", "place")
    spans = kept(whole.unionByName(single).groupBy("d", "k").agg(F.collect_list(F.struct("start", "n", "source", "place")).alias("spans")), "spans")
    drop(sources, contexts, windows, first)
    return spans


def factors(start: np.ndarray, n: np.ndarray, source: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows (start, windows, source, place) of a document's factors, in text order: runs that go on at the same place of the same source are one."""
    order = np.argsort(start, kind="stable")
    start, n, source, place = (x[order].astype(np.int64) for x in (start, n, source, place))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + n[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return np.stack([start[head], np.add.reduceat(n, head) if len(head) else n, source[head], place[head]], axis=1)


def substring_dedup(df: DataFrame, window: int = 20, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n_words, n_removed, kept_sha256; with_text also kept_text; carry: further columns of df to return."""
    carried = {f"c{i}_": c for i, c in enumerate(carry or [])}
    keep = list(carried)
    docs = df.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("d"), F.xxhash64("doc_id", "text").alias("k"), "text", *(F.col(c).alias(a) for a, c in carried.items()))
    found = kept(anchors(docs, window), "anchors")
    shared = kept(found.groupBy("anchor").count().where("count > 1").select("anchor"), "shared")
    hits = found.join(shared, "anchor", "left_semi").groupBy("k").agg(F.collect_set("anchor").alias("hits"))
    parsed = kept(parse(shrunk(docs, keep).join(hits, "k", "left"), window, keep, with_text), "parsed")
    drop(found, shared)
    spans = matches(parsed)
    open_ = parsed.where("sha IS NULL").select("doc_id", "d", "k", "n_words", "body", "own", *keep).join(spans, ["d", "k"], "left")
    out = untouched(parsed.where("sha IS NOT NULL"), keep).unionByName(finish(open_, window, keep, with_text))
    if not with_text:
        out = out.drop("kept_text")
    return out.select("doc_id", *(F.col(a).alias(c) for a, c in carried.items()), *(c for c in RESULT if with_text or c != "kept_text"))
