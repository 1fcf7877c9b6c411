"""Streaks over a stream of progress events (the batch form is operators.events.streaks)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUT = "operation long, event string, streak long"


def repeated_actions(stream: DataFrame, reset: str = "purchase", warn: int = 3) -> DataFrame:
    """(operation long, event string, ts timestamp) -> a row whenever an event has come `warn` times or more since the
    operation's last reset. State is the counts of one operation's events; events of a batch count in order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for event in rows["event"]:
            if event == reset:
                counts = {}
            counts[event] = counts.get(event, 0) + 1
            if counts[event] >= warn:
                out.append((key[0], event, counts[event]))
        state.update((list(counts), list(counts.values())))
        yield pd.DataFrame(out, columns=["operation", "event", "streak"])

    return stream.groupBy("operation").applyInPandasWithState(step, OUT, "events array<string>, counts array<long>", "append", "NoTimeout")
