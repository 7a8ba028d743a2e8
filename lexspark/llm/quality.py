"""Quality classifier: ridge regression on random Fourier features of document statistics.

One pass turns each whole text into a few statistics. Random Fourier features
approximate a Gaussian kernel over them; each partition of the labelled rows sums its
part of the normal equations, a few matrices reach the driver, and out-of-fold scores
are calibrated by isotonic regression on a fixed number of score bins.

The model is fitted on labelled rows, at most about ``max_train`` of them (chosen by a
hash of doc_id); everything else covers all rows. Scores use the text only.

Defined results: a null text counts as empty; empty texts get a score like any other;
with no labelled rows every score is 0.5; labels that are null or whose document is
absent are ignored; rows are scored one by one, so repeated rows give repeated results;
other columns are not read; an empty table gives an empty result; texts of any length are
measured whole; texts of equal statistics have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.storage import kept
from lexspark.llm.words import DocBatch, later, map_texts, repeated, within

FOLDS = 3
BINS = 1000
PARTS = 16
CLASSES = {
    "upper": np.isin(np.arange(256), list(range(65, 91))),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]) | (np.arange(256) >= 0xC0),
    "digit": np.isin(np.arange(256), list(range(48, 58))),
    "symbol": np.isin(np.arange(256), list(b"#*$%&<>@^~=+_{}[]\\/")),
    "bar": np.isin(np.arange(256), list(b"|")),
    "shout": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".")),
    "comma": np.isin(np.arange(256), list(b",;:")),
    "line": np.isin(np.arange(256), list(b"\n")),
    "wide": np.arange(256) >= 0xC0,
}


def statistics(batch: DocBatch) -> np.ndarray:
    """One row of document statistics a text; shares enter by their square root."""
    size = np.maximum(np.diff(batch.offsets), 1)
    words = np.maximum(batch.n_words, 1)
    starts, ends = batch.spans
    length = np.minimum(ends - starts, 40)
    mean = batch.word_sums(length) / words
    spread = np.sqrt(np.maximum(batch.word_sums(length * length) / words - mean**2, 0))
    counts = {k: batch.sums(v[batch.data]) for k, v in CLASSES.items()}
    doc = batch.doc_of_word
    own = within(batch.word_hashes, doc)
    distinct = batch.word_sums(~later(own)) / words
    at, grams = batch.grams(3)
    covered = batch.word_sums(batch.covered(at[repeated(within(grams, doc[at]))], 3)) / words
    echo = np.zeros(len(own), bool)
    echo[1:] = own[1:] == own[:-1]
    short = batch.word_sums(length <= 3) / words
    line_doc, a, b, line_words = batch.lines
    full = np.flatnonzero(line_words > 0)
    again = later(within(batch.hash_spans(a[full], b[full]), line_doc[full]))
    lines = np.maximum(np.bincount(line_doc[full], minlength=batch.n_docs), 1)
    same_lines = np.bincount(line_doc[full][again], minlength=batch.n_docs) / lines
    letters = np.maximum(counts["letter"], 1)
    shares = [counts["upper"] / letters, counts["letter"] / size, counts["digit"] / size, counts["symbol"] / size, counts["bar"] / size, counts["shout"] / size, counts["stop"] / words, counts["comma"] / words, counts["line"] / words, counts["wide"] / size, distinct, covered, batch.word_sums(echo) / words, short, same_lines]
    return np.stack([np.log1p(batch.n_words), mean, spread, np.log1p(batch.n_words / lines), *(np.sqrt(np.minimum(s, 4)) for s in shares)], axis=1).astype(np.float32)


def with_statistics(df: DataFrame) -> DataFrame:
    kind = df.schema["doc_id"].dataType.simpleString()

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(DocBatch.of(part.column("text")))
        stats = pa.array([row.tobytes() for row in x], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), stats], ["doc_id", "stats"])

    return map_texts(df.select("doc_id", "text"), one, f"doc_id {kind}, stats binary")


def matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1).astype(np.float64)


def summed(df: DataFrame, fn) -> np.ndarray | None:
    """Sum over partitions of fn(stats, y, fold), an array of fixed shape."""

    def run(batches):
        total = None
        for part in batches:
            if part.num_rows:
                x = fn(matrix(part.column("stats")), part.column("y").to_numpy().astype(np.float64), part.column("fold").to_numpy())
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["sum", "shape"])

    rows = df.mapInArrow(run, "sum binary, shape array<int>").collect()  # one row a partition, of which there are PARTS
    return sum(np.frombuffer(r["sum"], np.float64).reshape(r["shape"]) for r in rows) if rows else None


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Rising rate for each bin: pool adjacent violators; empty bins take their neighbours' line."""
    used = np.flatnonzero(counts)
    blocks: list[list[float]] = []
    for i in used:
        blocks.append([positives[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + n, blocks[-1][2] + k]
    rates = np.concatenate([np.full(int(k), (p + 0.5) / (n + 1)) for p, n, k in blocks])
    return np.interp(np.arange(len(counts)), used, np.maximum.accumulate(rates))


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # a column a fold left out; the last: all folds
    rates: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, z, np.ones((len(x), 1))], axis=1)

    def bins(self, x: np.ndarray, column: np.ndarray | int = -1) -> np.ndarray:
        raw = self.lift(x) @ self.weights
        raw = raw[:, column] if np.isscalar(column) else raw[np.arange(len(x)), column]
        return np.clip(np.nan_to_num((raw + 0.5) / 2 * BINS), 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.bins(x), np.arange(BINS), self.rates)


def fit(stats: DataFrame, labels: DataFrame, max_train: int = 200_000, waves: int = 256, width: float = 4.0, ridge: float = 1e-4, seed: int = 11) -> QualityModel | None:
    """Fit on rows of ``labels`` (doc_id, quality) whose crc32 of the doc_id as text, mod 3, is not 1."""
    key = F.crc32(F.col("doc_id").cast("string"))
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(key % 3 != 1)
    share = min(1.0, max_train / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    y = (F.col("quality") == 1).cast("double").alias("y")
    train = stats.join(usable.select("doc_id", y), "doc_id").select("doc_id", "stats", "y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS))).cast("int").alias("fold"))
    train = kept(train.repartition(PARTS, "doc_id").drop("doc_id"), "train")  # by row, not by content: copies spread

    moments = summed(train, lambda x, y, fold: np.stack([np.ones(x.shape[1]) * len(x), x.sum(axis=0), (x * x).sum(axis=0)]))
    if moments is None:
        return None
    n = moments[0, 0]
    centre = moments[1] / n
    scale = np.sqrt(np.maximum(moments[2] / n - centre**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    model = QualityModel(centre, scale, rng.normal(0, 1 / width, (len(centre), waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros((1, FOLDS + 1)), np.zeros(BINS))

    def equations(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = np.concatenate([model.lift(x), y[:, None]], axis=1)
        return np.stack([z[fold == f].T @ z[fold == f] for f in range(FOLDS)])

    parts = summed(train, equations)
    total = parts.sum(axis=0)
    columns = []
    for left_out in [*range(FOLDS), None]:
        a = total if left_out is None else total - parts[left_out]
        columns.append(np.linalg.solve(a[:-1, :-1] + ridge * max(n, 1) * np.eye(len(a) - 1), a[:-1, -1]))
    model.weights = np.stack(columns, axis=1)

    def binned(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        at = model.bins(x, fold).round().astype(np.int64)
        return np.stack([np.bincount(at, minlength=BINS).astype(np.float64), np.bincount(at, weights=y, minlength=BINS)])

    model.rates = isotonic(*summed(train, binned))
    return model


def score_quality(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of df (doc_id, text): held_out, score and predicted."""
    stats = kept(with_statistics(df), "stats")
    model = df.sparkSession.sparkContext.broadcast(fit(stats, labels, **options))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in batches:
            if part.num_rows:
                score = model.value.score(matrix(part.column("stats"))) if model.value else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
