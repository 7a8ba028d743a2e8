"""Best-two-fit packing of tokenised documents into sequences.

Documents are tokenised where they lie and cut into pieces. Pieces of one length are
interchangeable, so the packing itself is solved on the histogram of lengths: at most
``capacity`` classes, whatever the number of documents. The plan is a list of bin
patterns, each used many times; every pattern uses up a length, so there are at most
``capacity`` of them. A piece then finds its place from its rank within its length,
ranked within (length, salt) groups so that a hot length is no hot task.

Defined results: a null or empty text is the single id 0; repeated rows are packed one
by one; columns other than ``doc_id`` and ``text`` are not read; an empty table gives an
empty result; a text longer than the capacity is cut, its first piece taking the rest, and
texts of any length are tokenised whole; pieces of one length are placed by a salted order of
doc_id, equal rows in any order.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.layout import spread
from lexspark.storage import kept
from lexspark.llm.words import sliced

SALTS = 64
PROBE = "It's a probe, isn't it?  Zwei\n\nÜbergrößen für 1234 €\t<|x|> naïve 東京 \U0001f600 "
#: Fixed: the pattern by which the public byte-level vocabulary was split.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str):
    """text -> ids as numpy uint32, equal to the tokenizers library's without special tokens added.

    The ranks of the same vocabulary file drive the faster engine; texts that spell a
    special token, and vocabularies on which the two engines differ, take the slower one.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def plain(text: str) -> np.ndarray:
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    try:
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        same = fast.encode_ordinary(PROBE) == slow.encode(PROBE, add_special_tokens=False).ids
    except (KeyError, ValueError):
        same = False
    if not same:
        return plain

    def quick(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        return np.asarray(fast.encode_ordinary(text), np.uint32)

    return quick


def pieces(df: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(vocabulary or default_vocabulary())
        for part in sliced(batches):
            ids, rows = part.column("doc_id"), []
            for i, text in enumerate(part.column("text")):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                first = len(tokens) % capacity or min(capacity, len(tokens))
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
            if rows:
                at, k, start, length, crc = (pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(at), k.cast(pa.int32()), start, length, crc], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(df.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, longest first; number of bins) that use counts[l] pieces of each length l.

    Each pattern starts with the longest piece left and takes the longest that fits until none
    does; then its shortest piece goes back if two pieces left fill the widened gap more tightly.
    """
    left = counts.astype(np.int64).copy()
    live = [int(x) for x in np.flatnonzero(left)]
    plan: list[tuple[list[int], int]] = []
    while live:
        used: dict[int, int] = {}
        bin_, gap, at = [live[-1]], capacity - live[-1], len(live) - 1
        used[live[-1]] = 1
        while gap and (at := bisect_right(live, gap, 0, at + 1) - 1) >= 0:
            length = live[at]
            take = min(gap // length, int(left[length]) - used.get(length, 0))
            if take > 0:
                bin_ += [length] * take
                used[length] = used.get(length, 0) + take
                gap -= length * take
            at -= 1
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            used[smallest] -= 1
            room = gap + smallest
            free = [x for x in live[: bisect_right(live, room)] if left[x] > used.get(x, 0)]
            best, i, j = (smallest, -1, -1), 0, len(free) - 1
            while i <= j:
                a, b = free[i], free[j]
                if a + b > room:
                    j -= 1
                    continue
                if a + b > best[0] and (a != b or left[a] - used.get(a, 0) >= 2):
                    best = (a + b, a, b)
                i += 1
            if best[1] >= 0:
                bin_[-1:] = [best[2], best[1]]
                for x in best[1:]:
                    used[x] = used.get(x, 0) + 1
            else:
                used[smallest] += 1
        times = min(int(left[x]) // n for x, n in used.items() if n)
        for x, n in used.items():
            left[x] -= times * n
        live = [x for x in live if left[x] > 0]
        plan.append((sorted(bin_, reverse=True), times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, places a bin, first offset) by ascending rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset, k = 0, 0
        while k < len(lengths):
            length = lengths[k]
            n = lengths.count(length)
            out.setdefault(length, []).append((taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += n * length
            k += n
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(df: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Pieces of df (doc_id, text) with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` as found."""
    salted = pieces(df, capacity, vocabulary).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32") + F.spark_partition_id(), F.lit(SALTS)).cast("int"))  # equal rows spread too
    table = kept(salted, "pieces")
    counts = np.zeros((capacity + 1, SALTS), np.int64)  # bounded by capacity and SALTS
    for r in table.groupBy("length", "salt").count().collect():
        counts[r["length"], r["salt"]] = r["count"]
    places = slots(best_two_fit(counts.sum(axis=1), capacity))
    before = np.cumsum(counts, axis=1) - counts
    plan = df.sparkSession.sparkContext.broadcast((places, before))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = table.withColumn("rank", F.row_number().over(order) - 1)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        places, before = plan.value
        for part in batches:
            length, salt = part.column("length").to_numpy(), part.column("salt").to_numpy()
            rank = part.column("rank").to_numpy() + before[length, salt]
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                rows = places[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                inside = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + inside // row[:, 2]
                offset[own] = row[:, 3] + inside % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(sequence), pa.array(offset)], [*out, "sequence_id", "offset"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
