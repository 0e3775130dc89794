"""Deliveries that are tried again: attempts, back-off, giving up (rows R02, R03).

Every paper has a state of its own in the state store: how often it was tried
and when it is due.  A timer in event time brings it out again, so that the
schedule is that of the events whatever the pace at which they are read, and
a restart from the checkpoint goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts before a paper is given up, and seconds until the first further one; each wait is twice the one before.
MOST, WAIT = 4, 60
OUT = "paper_key string, action string, attempt int, at timestamp"


class Retries(StatefulProcessor):
    """Events (paper_key, event, ts): ``new`` asks for a delivery, ``failed`` for another one later, ``done`` and ``release`` forget the paper."""

    def __init__(self, most: int = MOST, wait: int = WAIT):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "attempt int, due long")

    def _due(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")
        out = []
        for event, ts in zip(events["event"], events["ts"], strict=True):
            held = self.state.get() if self.state.exists() else None
            if event == "new" and held is None:
                self.state.update((1, 0))
                out.append((key[0], "deliver", 1, ts))
            elif event == "failed" and held is not None and not held[1]:
                if held[0] >= self.most:
                    out.append((key[0], "give_up", held[0], ts))
                    self.state.clear()
                else:
                    due = int(ts.timestamp() * 1000) + 1000 * self.wait * 2 ** (held[0] - 1)
                    self.state.update((held[0], due))
                    self.handle.registerTimer(due)
            elif event in ("done", "release") and held is not None:
                self._due()
                self.state.clear()
                if event == "release":
                    out.append((key[0], "released", held[0], ts))
        if out:
            yield pd.DataFrame(out, columns=["paper_key", "action", "attempt", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        if held is not None and held[1] and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((held[0] + 1, 0))
            yield pd.DataFrame([(key[0], "deliver", held[0] + 1, pd.Timestamp(held[1], unit="ms"))], columns=["paper_key", "action", "attempt", "at"])

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, most: int = MOST, wait: int = WAIT, delay: str = "0 seconds") -> DataFrame:
    """A stream of events (paper_key, event, ts) to what is to be done: deliver (attempt 1, 2, ...), give_up, released.

    A failed delivery is due again after ``wait`` seconds, then twice as many,
    and so on, and given up after ``most`` attempts.  A second ``new`` of a
    paper that is held, and events of one that is not, change nothing.  Needs
    the RocksDB state store.
    """
    return events.withWatermark("ts", delay).groupBy("paper_key").transformWithStateInPandas(statefulProcessor=Retries(most, wait), outputStructType=OUT, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")
