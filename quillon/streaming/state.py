"""Rate budgets with state, and dropping stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.session import removed


def rebuilt(spark: SparkSession, *paths: str) -> None:
    """Drops index, state and checkpoint, so that the next run starts from nothing."""
    for path in paths:
        removed(spark, path)


def admitted(calls: list[tuple[float, int]], budget: int, span: float = 60.0) -> list[float]:
    """Start times of calls (arrival, tokens) under a rolling budget: at once if the window's tokens and its own fit or
    the window is empty, else when enough has expired, and 0.1 s."""
    window: list[tuple[float, int]] = []
    starts, now = [], float("-inf")
    for arrival, tokens in calls:
        now = max(now, arrival)
        while True:
            window = [(t, n) for t, n in window if now - t < span]
            if not window or sum(n for _, n in window) + tokens <= budget:
                break
            now = window[0][0] + span + 0.1
        window.append((now, tokens))
        starts.append(now)
    return starts


def paced(calls: DataFrame, budget: int = 27_000, span: float = 60.0) -> DataFrame:
    """Streaming calls (key, ts double, tokens) with the start that a rolling budget for each key admits.

    Late rows within a batch are sorted; state holds the window's calls and the last start.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        times, sizes, last = state.get if state.exists else ([], [], 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "tokens"], kind="stable")
        held = list(zip(times, sizes, strict=True))
        calls = [(max(t, last), int(n)) for t, n in zip(rows["ts"], rows["tokens"], strict=True)]
        starts = admitted(held + calls, budget, span)[len(held) :]
        kept = [(t, n) for t, n in held + [(s, n) for s, (_, n) in zip(starts, calls, strict=True)] if starts[-1] - t < span]
        state.update(([t for t, _ in kept], [n for _, n in kept], float(starts[-1])))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "tokens": rows["tokens"].to_numpy(), "start": starts})

    return calls.groupBy("key").applyInPandasWithState(
        step, "key long, ts double, tokens long, start double", "times array<double>, sizes array<long>, last double", "append", GroupStateTimeout.NoTimeout
    )
