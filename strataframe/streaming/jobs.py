"""Streaming forms: incremental index, activity windows, decisions. Ingest deduplication is in :mod:`.uploads`."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.decisions import next_state
from . import index

#: The state store that decisions need; set ``spark.sql.streaming.stateStore.providerClass`` to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_activity(events: DataFrame, ts: str = "ts", action: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of actions in tumbling windows; a window is final once the watermark has passed it."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "action", "n")


def stream_index(chunks: DataFrame, path: str, checkpoint: str, model: str, dimension: int, buckets: int = index.BUCKETS) -> StreamingQuery:
    """Merge new chunks ``(chunk_id, chunk)`` into the index at ``path``: each batch rewrites the buckets whose chunks it changes.

    A batch that is repeated after a failure finds its label in the last version, or else writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        index.merge(batch.sparkSession, path, batch, model, dimension, f"{checkpoint}#{number}", buckets)

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Decisions that wait together as one entry of the state.
PACKED = 4096
_next = lru_cache(4096)(next_state)


class _Decisions(StatefulProcessor):
    """Decisions of one candidate wait until the watermark has passed them, then they are folded in order.

    They wait in packs, as each entry written to or read from the state costs a call.
    """

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, last long")
        self.waiting = handle.getListState("waiting", "at array<long>, seq array<long>, action array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            at, seq, action = some["at"].tolist(), some["seq"].tolist(), some["action"].tolist()
            self._wait(list(zip(at, seq, action, strict=True)))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def _wait(self, rows: list[tuple[int, int, str]]) -> None:
        for i in range(0, len(rows), PACKED):
            self.waiting.appendValue(tuple(map(list, zip(*rows[i : i + PACKED], strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for pack in self.waiting.get() if self.waiting.exists() else ():
            for r in zip(*pack, strict=True):
                (ready if r[0] < mark else later).append(r)
        state, last = self.state.get() if self.state.exists() else ("PENDING", 0)
        out = []
        for at, seq, action in sorted(ready, key=lambda r: (r[1], r[2])):
            if self.idle is not None and last and at - last > self.idle:
                state = "PENDING"  # forgotten, whether or not its timer has been
            state, outcome = _next(state, action)
            out.append((key[0], seq, action, state, outcome))
            last = max(last, at)
        if ready:
            self.state.update((state, last))
            self.waiting.clear()
            self._wait(later)
        if later:
            self.handle.registerTimer(min(r[0] for r in later) + 1)
        elif self.idle is not None:
            if not ready and last + self.idle < mark:
                self.state.clear()
            else:
                self.handle.registerTimer(last + self.idle + 1)
        if out:
            yield pd.DataFrame(out, columns=["id", "seq", "action", "state", "outcome"])

    def close(self) -> None:
        pass


def stream_decisions(decisions: DataFrame, ts: str = "ts", late: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """Decisions ``(id, seq, action)`` with the state and outcome that they lead to, in order of ``seq`` whatever order they arrive in.

    A candidate starts PENDING. A decision waits until the watermark, ``late`` behind the newest one seen, has passed its
    time ``ts``, along which ``seq`` rises; one that comes later than that is dropped, as in any stream with a watermark. With
    ``idle_ms`` a candidate is forgotten so long after its last decision and begins anew. Needs :data:`STATE_STORE`.
    """
    timed = decisions.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = timed.select("id", F.col("seq").cast("long").alias("seq"), "action", ts, F.unix_millis(ts).alias("at"))
    return rows.groupBy("id").transformWithStateInPandas(_Decisions(idle_ms), "id long, seq long, action string, state string, outcome string", "Append", "EventTime")
