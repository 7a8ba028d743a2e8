"""The stateful frontier over a stream of files."""

import json

import pytest
from lexspark.streaming.frontier import EVENT, schedule


def added(*urls, depth=0, seq=0):
    return [{"domain": "d", "kind": "add", "url": u, "depth": depth, "seq": seq + i, "ms": 0} for i, u in enumerate(urls)]


def done(url, seq, ms, success=True, retry=False, wait=None):
    return {"domain": "d", "kind": "done", "url": url, "seq": seq, "ms": ms, "success": success, "retry": retry, "wait_ms": wait}


@pytest.fixture
def play(spark, tmp_path):
    """Feed events file by file; returns the rows of each step."""
    source, n = tmp_path / "in", [0]
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def step(events, **options):
        (source / f"{n[0]}.json").write_text("\n".join(map(json.dumps, events)))
        out = tmp_path / f"out{n[0]}"
        n[0] += 1
        stream = schedule(spark.readStream.schema(EVENT).json(str(source)), interval_ms=1000, **options)
        got = []
        stream.writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert not out.exists()
        return got

    yield step
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_order_and_politeness(play):
    assert play([*added("u1", depth=1), *added("u2", "u3", depth=0, seq=1), *added("u2", depth=0, seq=5)]) == [("d", "u1", "fetch", 0, 0)]
    assert play([done("u1", 9, 500)]) == [("d", "u1", "done", 500, 0), ("d", "u2", "fetch", 1500, 0)]
    assert play([done("u2", 10, 2000), done("u3", 11, 4000)]) == [("d", "u2", "done", 2000, 0), ("d", "u3", "fetch", 3000, 0), ("d", "u3", "done", 4000, 0)]
    assert play(added("u3", seq=20)) == []


def test_retries(play):
    assert play(added("a", "b")) == [("d", "a", "fetch", 0, 0)]
    assert play([done("a", 5, 100, False, True)]) == [("d", "a", "fetch", 30_100, 1)]
    assert play([done("a", 6, 40_000, False, True, 5000)]) == [("d", "a", "fetch", 45_000, 2)]
    assert play([done("a", 7, 50_000, False, True)]) == [("d", "a", "error", 50_000, 3), ("d", "b", "fetch", 51_000, 0)]


def test_blocked_domain(play):
    assert play([*added("a", "b", "c"), done("a", 5, 10, False), done("b", 6, 20, False)], block_after=2) == [("d", "a", "fetch", 0, 0), ("d", "a", "done", 10, 0), ("d", "b", "fetch", 1010, 0), ("d", "b", "done", 20, 0), ("d", "c", "skipped", 20, 0)]
    assert play(added("e", seq=9), block_after=2) == [("d", "e", "skipped", 0, 0)]
