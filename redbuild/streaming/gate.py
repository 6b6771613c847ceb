"""Lines that wait in state until their failure's logs are all there.

Lines and collect events are one stream.  A failure's lines are kept in list state, dealt over `parts` keys, so that no
single key holds a failure; its collect event goes to all of them and lets the lines go on in the same micro-batch, however
long after the last line it comes.  If none comes in time, a timer says so.  Time is that at which rows have landed, so
a replay decides as the first run did.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PARTS = 16
STRETCH = 4096  # neighbouring lines of a stage that wait together
AT_ONCE = 10_000
LINE = ["stage", "line_no", "raw"]
#: kind is line (of a failure whose logs are there), late (a line after that), collected or expired (one row each for a failure or a part of it).
RELEASED = "failure_id string, kind string, stage string, line_no long, raw string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "stage string, line_no bigint, raw string")
        self.state = handle.getValueState("state", "name string")  # waiting, open or expired

    def _rows(self, failure: str, kind: str, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=LINE).astype({"line_no": "Int64"})
        frame.insert(0, "kind", kind)
        frame.insert(0, "failure_id", failure)
        return frame

    def _let_go(self, failure: str) -> Iterator[pd.DataFrame]:
        held = []
        for row in self.lines.get():
            held.append(tuple(row))
            if len(held) == AT_ONCE:
                yield self._rows(failure, "line", held)
                held = []
        if held:
            yield self._rows(failure, "line", held)
        self.lines.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failure, part = key[0], int(key[1])
        name = self.state.get()[0] if self.state.exists() else None
        collected, landed = False, None
        for batch in rows:
            first = batch["received_at"].min()
            landed = first if landed is None else min(landed, first)
            collected |= bool((batch["kind"] == "collected").any())
            own = batch[batch["kind"] == "line"]
            if len(own):
                found = [(s, int(n), r) for s, n, r in zip(own["stage"], own["line_no"], own["raw"])]
                if name in ("open", "expired"):
                    yield self._rows(failure, "late", found)
                else:
                    self.lines.appendList(found)
        if name in ("open", "expired"):
            return
        if collected:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.update(("open",))
            if part == 0:
                yield self._rows(failure, "collected", [(None, None, None)])
            yield from self._let_go(failure)
        elif name is None:
            self.state.update(("waiting",))
            self.handle.registerTimer(int(landed.timestamp() * 1000) + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] == "waiting":
            self.state.update(("expired",))
            self.lines.clear()
            yield self._rows(key[0], "expired", [(None, None, None)])

    def close(self) -> None:
        pass


def gated_lines(
    lines: DataFrame, collected: DataFrame, wait_ms: int = 24 * 3600 * 1000, parts: int = PARTS, delay: str = "1 hour"
) -> DataFrame:
    """Streams of lines and of (failure_id) whose logs are all there, both with received_at -> rows as RELEASED says.

    Rows that land more than `delay` behind the latest may be dropped; a failure waits wait_ms for its collect event.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    part = F.pmod(F.xxhash64("stage", F.floor(F.col("line_no") / STRETCH)), F.lit(parts)).cast("int")
    waiting = lines.select("failure_id", part.alias("part"), F.lit("line").alias("kind"), "stage", "line_no", "raw", "received_at")
    events = collected.select(
        "failure_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("collected").alias("kind"),
        F.lit(None).cast("string").alias("stage"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("raw"),
        "received_at",
    )
    both = waiting.unionByName(events).withWatermark("received_at", delay)
    return both.groupBy("failure_id", "part").transformWithStateInPandas(Gate(wait_ms), RELEASED, "append", "eventTime")
