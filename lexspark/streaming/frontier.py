"""A polite frontier as a stateful stream: one request in flight a domain, repeated after its delay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lexspark.operators.repository import ATTEMPTS, BACKOFF, BLOCK_AFTER, MOST_BACKOFF

OUTPUT = "domain string, url string, status string, ready_ms long, attempts int"
EVENT = "domain string, kind string, url string, depth int, seq long, ms long, success boolean, retry boolean, wait_ms long"


class PoliteFrontier(StatefulProcessor):
    """Per domain: queues of URLs by depth, each in order of arrival, the one in flight, failures in a row, and when the next may go.

    Events (kind): ``add`` puts a URL in its queue once; ``done`` ends the one in flight. With
    ``retry`` it goes back to the front of its queue and the domain waits: wait_ms where the server
    named a time, else BACKOFF seconds doubled with each attempt, up to MOST_BACKOFF; after
    ATTEMPTS it ends as an error. A domain is blocked after block_after failures in a row, and
    what is left of it is skipped.

    Rows out: status ``fetch`` when a URL may be fetched (from ready_ms on), and each end of one:
    ``done``, ``error`` or ``skipped``.

    A queue is numbered places with the first and last in use: taking and adding touch one entry,
    whatever its length, and a taken entry is removed. URLs seen are kept so that none is
    fetched twice, for ttl_ms where given.
    """

    def __init__(self, interval_ms: int = 1000, block_after: int = BLOCK_AFTER, ttl_ms: int | None = None):
        self.interval_ms, self.block_after, self.ttl_ms = interval_ms, block_after, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.seen = handle.getMapState("seen", "url string", "depth int", **ttl)
        self.queue = handle.getMapState("queue", "depth int, place long", "url string, attempts int", **ttl)
        self.ends = handle.getMapState("ends", "depth int", "first long, last long", **ttl)
        self.domain = handle.getValueState("domain", "flying string, depth int, attempts int, failures int, ready_ms long", **ttl)

    def push(self, depth: int, url: str, attempts: int, front: bool = False) -> None:
        first, last = self.ends.getValue((depth,)) if self.ends.containsKey((depth,)) else (0, 0)
        first, last = (first - 1, last) if front else (first, last + 1)
        self.queue.updateValue((depth, first if front else last - 1), (url, attempts))
        self.ends.updateValue((depth,), (first, last))

    def pop(self) -> tuple[int, str, int] | None:
        """The first URL of the least depth that has one; depths are few."""
        waiting = sorted(k[0] for k, v in self.ends.iterator() if v[0] < v[1])
        if not waiting:
            return None
        depth = waiting[0]
        first, last = self.ends.getValue((depth,))
        url, attempts = self.queue.getValue((depth, first))
        self.queue.removeKey((depth, first))
        self.ends.updateValue((depth,), (first + 1, last))
        return depth, url, attempts

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flying, depth, attempts, failures, ready = self.domain.get() if self.domain.exists() else (None, 0, 0, 0, 0)
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events.itertuples():
            if e.kind == "add":
                if not self.seen.containsKey((e.url,)):
                    self.seen.updateValue((e.url,), (int(e.depth),))
                    if failures < self.block_after:
                        self.push(int(e.depth), e.url, 0)
                    else:
                        out.append((key[0], e.url, "skipped", int(e.ms), 0))
            elif flying == e.url:
                again, pause = bool(e.retry) if pd.notna(e.retry) else False, self.interval_ms
                failures = 0 if e.success else failures + 1
                if again and attempts + 1 < ATTEMPTS:
                    attempts += 1
                    named = int(e.wait_ms) if pd.notna(e.wait_ms) else min(MOST_BACKOFF, BACKOFF * 2 ** (attempts - 1)) * 1000
                    pause = max(pause, named)
                    self.push(depth, flying, attempts, front=True)
                else:
                    out.append((key[0], flying, "error" if again else "done", int(e.ms), attempts + int(again)))
                ready = max(int(ready), int(e.ms) + pause)
                flying = None
            if flying is None and failures < self.block_after:
                if (found := self.pop()) is not None:
                    depth, flying, attempts = found
                    out.append((key[0], flying, "fetch", max(int(ready), int(e.ms)), attempts))
            elif flying is None:
                while (found := self.pop()) is not None:
                    out.append((key[0], found[1], "skipped", int(e.ms), found[2]))
        self.domain.update((flying, depth, attempts, failures, int(ready)))
        yield pd.DataFrame(out, columns=["domain", "url", "status", "ready_ms", "attempts"])

    def close(self) -> None:
        pass


def schedule(events: DataFrame, **options) -> DataFrame:
    """Requests to make and tasks that ended, from a stream of events (EVENT)."""
    return events.groupBy("domain").transformWithStateInPandas(PoliteFrontier(**options), StructType.fromDDL(OUTPUT), "append", "ProcessingTime" if options.get("ttl_ms") else "None")
