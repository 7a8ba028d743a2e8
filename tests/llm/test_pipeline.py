"""The corpus pipeline, each stage against brute force on its own input."""

import re

import corpus_pipeline
from test_operators import SPACES, brute_components, brute_hits, check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "substrings", "decontamination", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        frames[name] = docs

    kept = {n: {r["doc_id"]: r for r in f.collect()} for n, f in frames.items() if n != "packing"}
    assert all(re.search(r"[^\W\d_]", r["text"]) for r in kept["language"].values()) and len(kept["language"]) >= len(before) - 3

    want = brute_components({i: r["text"] for i, r in kept["language"].items()}, 5, 80)
    assert set(kept["near_dedup"]) == {c for _, c in want.values()}

    seen, left = set(), {}
    for i, r in sorted(kept["near_dedup"].items()):
        w = re.findall(SPACES, r["text"])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        left[i] = " ".join(x for x, y in zip(w, gone, strict=True) if not y) if any(gone) else r["text"]
    assert {i: r["text"] for i, r in kept["substrings"].items()} == {i: t for i, t in left.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substrings"].values() if r["text"] != kept["near_dedup"][r["doc_id"]]["text"])

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, _, _, n, _, _ in brute_hits([(i, r["text"]) for i, r in kept["substrings"].items()], items) if n == 0}
    assert set(kept["decontamination"]) == clean

    check_packing(frames["packing"].toPandas(), {i: r["text"] for i, r in kept["decontamination"].items()})
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_clashing_columns_pass(spark, sf):
    """Extra columns named like those that stages make keep their values through all stages but the last."""
    names = ["k", "d", "hits", "body", "accepted", "host", "component_id", "kept", "kept_text", "n_removed", "contaminated", "item"]
    text = "the and of to be or not " * 8
    docs = spark.createDataFrame([(i, text + f"unlike{i} " * 9, "en", "s", 9, *(f"{n}{i}" for n in names)) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
        assert docs.columns == [*COLUMNS, *names], name
        assert docs.count() and all(r[n] == f"{n}{r['doc_id']}" for r in docs.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_odd_documents(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the and of to be or not " * 5, "en", "s", 9), (4, "the and of to be or not " * 5, "en", None, 9), (4, "the and of to be or not " * 5, "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "near_dedup":
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) in ([0, 4], [4])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
