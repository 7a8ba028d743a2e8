"""Near duplicates by SuperMinHash.

Each text's distinct word shingles give a SuperMinHash signature: an element ranks the
slots by one random permutation, so the slots' minima are anti-correlated (lower
variance than independent hashes), and a text stops as soon as no later rank can lower
a slot. Bands of the signature propose candidates; full shingle sets decide; union-find
groups.

Scale. Texts with equal sets collapse first (a partial aggregation, so a third of all
rows may be copies). Buckets are joined to their least member, never paired inside: a set is
compared with the centres of its buckets, at most one a band, and the links found are grouped.
A star is what shares a bucket of one centre. A link that no centre shows joins two groups within
a star; only there, members go on to blocks of a bounded number of shingles. Pairs whose
distances to the centre differ by more than a link's are never met (the triangle inequality), nor are
those connected with the centre on both sides. What is left grows with the square of the
members of one star that stand equally far from its centre and belong to different groups.

Defined results: null and empty texts, and texts without words, have the empty set and
are linked with nothing; a text of fewer words than a shingle is one shingle; rows of
equal ``doc_id`` are one document, each returned; rows without ``doc_id`` are returned
with ``component_id`` null and ``kept`` true; of ties the least ``doc_id`` names the group and
stays; doc_id is an integer; texts of any length are hashed and compared whole; columns other
than ``doc_id`` and ``text`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.graph import components
from lexspark.storage import drop, kept
from lexspark.llm.words import GRAM, DocBatch, map_texts, mix

BAND_ROWS = 4
BANDS = 24
#: Most shingles and members of a verification block, on average.
BLOCK_SHINGLES = 100_000
BLOCK_MEMBERS = 400
UNSET = np.uint64(2**64 - 1)


def shingle_sets(batch: DocBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text; their texts; where each text's begin."""
    at, grams = batch.grams(size)
    doc = batch.doc_of_word[at]
    for n in range(1, size):
        if (batch.n_words == n).any():
            short_at, short = batch.grams(n)
            whole = batch.n_words[batch.doc_of_word[short_at]] == n
            grams = np.concatenate([grams, short[whole]])
            doc = np.concatenate([doc, batch.doc_of_word[short_at[whole]]])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, doc, np.searchsorted(doc, np.arange(batch.n_docs + 1))


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures of sets given as (element, doc). Rank j of an element stands in the top byte, above random bits."""
    out = np.full(n_docs * slots, UNSET, np.uint64)
    perm = None
    for j in range(slots):
        draw = mix(elements + np.uint64((j + 1) * int(GRAM) % 2**64))
        k = j + ((draw & np.uint64(0xFFFF_FFFF)) % np.uint64(slots - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out, doc * slots + slot, (np.uint64(j) << np.uint64(56)) | (mix(draw) >> np.uint64(8)))
        open_ = (out.reshape(n_docs, slots) == UNSET).any(axis=1)
        going = open_[doc]
        if not going.any():
            break
        if perm is None:
            first = k[going]
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(first), 1))
            perm[np.arange(len(first)), first] = 0
        else:
            perm = perm[going]
        elements, doc = elements[going], doc[going]
    return out.reshape(n_docs, slots)


def signatures(df: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, the set's 128-bit fingerprint f1 and f2, and its band hashes."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        batch = DocBatch.of(part.column("text"), lower=True)
        grams, doc, cuts = shingle_sets(batch, size)
        n = np.diff(cuts)
        some = np.flatnonzero(n)
        f = np.zeros((2, batch.n_docs), np.uint64)
        bands = np.zeros((batch.n_docs, BANDS), np.uint64)
        if len(some):
            f[0, some] = np.add.reduceat(mix(grams), cuts[some])
            f[1, some] = np.add.reduceat(mix(grams ^ GRAM), cuts[some])
            sig = superminhash(grams, np.searchsorted(some, doc), len(some), BANDS * BAND_ROWS).reshape(len(some), BANDS, BAND_ROWS)
            acc = np.zeros((len(some), BANDS), np.uint64)
            for r in range(BAND_ROWS):
                acc = mix(acc * GRAM + sig[:, :, r])
            bands[some] = acc
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(bands[some].reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return map_texts(df.select("doc_id", "text"), one, f"doc_id {kind}, n_shingles long, f1 long, f2 long, bands array<bigint>")


def sets_of(df: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Per row: the columns to keep, and its shingle set as sorted 8-byte hashes."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        grams, _, cuts = shingle_sets(DocBatch.of(part.column("text"), lower=True), size)
        raw = grams.astype("<u8").tobytes()
        sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), sets], [*keep, "shingles"])

    return map_texts(df.select(*keep, "text"), one, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", shingles binary")


def star_links(df: DataFrame, percent: int) -> DataFrame:
    """(centre, rep, n, linked, ring) of rows with their set and their centre's.

    The ring counts the distance to the centre in steps of the largest distance of a link. Jaccard
    distance is a metric, so two sets whose rings differ by more than one are not linked.
    """
    step = max(100 - percent, 1)

    def run(batches):
        for part in batches:
            linked, ring = [], []
            for a, b in zip(part.column("shingles"), part.column("other"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                linked.append(100 * both >= percent * either)
                ring.append(100 * (either - both) // (step * either))
            yield pa.RecordBatch.from_arrays([part.column("centre"), part.column("rep"), part.column("n"), pa.array(linked, pa.bool_()), pa.array(ring, pa.int32())], ["centre", "rep", "n", "linked", "ring"])

    return df.select("centre", "rep", "n", "shingles", "other").mapInArrow(run, "centre long, rep long, n long, linked boolean, ring int")


def overlap_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, in bounded memory."""
    every = [*rows, *columns]
    values = np.concatenate(every) if every else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(values) else np.zeros(0, bool)
    values, owner = values[shared], owner[shared]
    column = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1 if len(values) else values.astype(np.int64)
    out = np.zeros((len(rows), len(columns)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        m = np.zeros((len(every), 4096), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        out += m[: len(rows)] @ m[len(rows) :].T
    return out


def block_links(percent: int):
    """Edges of one pair of blocks: links that connect groups not yet connected, as few as do."""

    def run(table: pa.Table) -> pa.Table:
        rep, group, own, low, high = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "own", "low", "high"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        edges: list[tuple[int, int]] = []
        if len(left) and len(np.unique(group)) > 1:
            both = overlap_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
            size = np.array([len(s) for s in sets])
            ok = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            ok &= group[left][:, None] != group[right][None, :]
            root = {int(g): int(g) for g in group}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in np.argwhere(ok):
                a, b = find(int(group[left[i]])), find(int(group[right[j]]))
                if a != b:
                    root[a] = b
                    edges.append((int(group[left[i]]), int(group[right[j]])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """(rep, centre) of the sets that share a bucket with a lesser one: the least of each of their buckets."""
    entries = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    buckets = kept(entries.groupBy("band", "value").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    found = kept(entries.join(buckets, ["band", "value"]).where("rep <> centre").select("rep", "centre").distinct(), "candidates")
    drop(buckets)
    return found


def unconnected(star: DataFrame, first: DataFrame) -> DataFrame:
    """Members of stars that hold groups the centre isn't connected with: (centre, rep, n, ring, component, loose)."""
    group = first.withColumnsRenamed({"node": "rep", "component": "own_group"})
    middle = first.withColumnsRenamed({"node": "centre", "component": "centre_group"})
    rows = star.join(group, "rep", "left").join(middle, "centre", "left").withColumn("component", F.coalesce("own_group", "rep"))
    rows = rows.withColumn("loose", F.col("component") != F.coalesce("centre_group", "centre"))
    return rows.select("centre", "rep", "n", "ring", "component", "loose")


def residual_links(sets: DataFrame, star: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups that share a star and that no centre connects.

    Members of a star meet in blocks, those of rings next to each other only, and a pair of which
    both are connected with the centre never.
    """
    rows = kept(unconnected(star, first).distinct(), "unconnected")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).cast("long")
    sizes = rows.groupBy("centre", "ring", "loose").agg(blocks.alias("blocks"), F.count("*").alias("members"))
    sizes = sizes.groupBy("centre").agg(F.collect_list(F.struct("ring", "loose", "blocks")).alias("rings"), F.max("loose").alias("some"), F.sum("members").alias("members"))
    sizes = kept(sizes.where("some AND members > 1").select("centre", "rings"), "rings")

    def code(loose, ring, block):
        """A block as one number; those of loose members come first."""
        return F.when(loose, 0).otherwise(1) * F.lit(2**48) + ring * F.lit(2**32) + block

    mine = F.element_at(F.filter("rings", lambda r: (r["ring"] == F.col("ring")) & (r["loose"] == F.col("loose"))), 1)["blocks"]
    near = F.filter("rings", lambda r: (F.abs(r["ring"] - F.col("ring")) <= 1) & (r["loose"] | F.col("loose")))
    others = F.flatten(F.transform(near, lambda r: F.transform(F.sequence(F.lit(0).cast("long"), r["blocks"] - 1), lambda i: code(r["loose"], r["ring"], i))))
    met = rows.join(sizes, "centre").withColumn("own", code(F.col("loose"), F.col("ring"), F.pmod(F.xxhash64("rep"), mine)))
    met = met.select("centre", "rep", "component", "own", F.explode(others).alias("other"))
    met = met.select("centre", "rep", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    unit = ["centre", "low", "high"]
    # a pair of blocks that holds one group only has nothing to compare
    worth = kept(met.groupBy(*unit).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(*unit), "pairs")
    met = kept(met.join(worth, unit), "met")
    edges = kept(sets.select("rep", "shingles").join(met, "rep").groupBy(*unit).applyInArrow(block_links(percent), "a long, b long"), "links")
    drop(rows, sizes, worth, met)
    return edges


def groups(df: DataFrame, classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (node, component): from sets to the groups that centres connect, and from those to whole groups."""
    found = candidates(classes)
    texts = df.select(F.col("doc_id").cast("long").alias("rep"), "text")
    ends = found.withColumn("middle", F.lit(False)).unionByName(found.select(F.col("centre").alias("rep"), F.lit(None).cast("long").alias("centre"), F.lit(True).alias("middle")).distinct())
    wanted = kept(ends.groupBy("rep").agg(F.collect_set("centre").alias("centres"), F.max("middle").alias("middle")), "wanted")
    sets = sets_of(texts.join(wanted, "rep"), size, ["rep", "centres", "middle"]).withColumn("n", (F.octet_length("shingles") / 8).cast("long"))
    sets = kept(sets.where("n > 0"), "sets")
    centres = sets.where("middle").select(F.col("rep").alias("centre"), F.col("shingles").alias("other"))
    star = kept(star_links(sets.withColumn("centre", F.explode("centres")).join(centres, "centre"), percent), "stars")
    first = kept(components(star.where("linked").select(F.col("rep").alias("a"), F.col("centre").alias("b"))), "groups")
    edges = residual_links(sets, star, first, percent)
    second = kept(components(edges), "merged")
    drop(found, wanted, sets, star, edges)
    return first, second


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of df (doc_id, text): n_shingles, component_id and kept.

    Texts are linked if 100 * |intersection| >= percent * |union| of their sets of ``size``-word
    shingles (letters A-Z lower-cased); component_id is the least doc_id reachable through links.
    A link at the limit is proposed by at least one band with probability above 1 - 4e-6.
    """
    table = kept(signatures(df, size), "signatures")
    sets = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = kept(sets.groupBy("f1", "f2").agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.first("bands").alias("bands")), "classes")
    first, second = groups(df, classes, size, percent)
    named = classes.select("f1", "f2", F.col("rep").alias("node")).join(first, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("node"))
    named = kept(named.join(second, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component_id")), "named")
    drop(classes, first, second)
    out = table.drop("bands").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    out = kept(out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))), "components")
    drop(table, named)
    return out
