"""Usage caps on a stream of requests: state for each deployment holds the day's count and each session's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.limits import DAY_CAP, SESSION_CAP

SCHEMA = "deployment long, request_id long, session long, outcome string"
#: The state's map lives in this store; set it as spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """One deployment's requests, in the order of their time within a batch.

    A session's count advances only if the day admits the request; a new day starts its own count and keeps the sessions'.
    A request from before the current day counts for the current one, as for a clock that doesn't go back.
    """

    def __init__(self, session_cap: int, day_cap: int) -> None:
        self.session_cap, self.day_cap = session_cap, day_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "day string, used long")
        self.sessions = handle.getMapState("sessions", "session long", "used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        day, used = tuple(self.day.get()) if self.day.exists() else ("", 0)
        counts, found = {}, []
        for request, session, at in zip(asked["request_id"], asked["session"], asked["ts"], strict=True):
            today = at.date().isoformat()
            if today > day:
                day, used = today, 0
            session = int(session)
            if session not in counts:
                counts[session] = self.sessions.getValue((session,))[0] if self.sessions.containsKey((session,)) else 0
            if counts[session] >= self.session_cap:
                outcome = "session_cap"
            elif used >= self.day_cap:
                outcome = "day_cap"
            else:
                outcome, used = "accept", used + 1
                counts[session] += 1
            found.append((key[0], int(request), session, outcome))
        self.day.update((day, used))
        for session, n in counts.items():
            self.sessions.updateValue((session,), (n,))
        yield pd.DataFrame(found, columns=["deployment", "request_id", "session", "outcome"])

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, session_cap: int = SESSION_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """Streaming requests (deployment, request_id, session, ts) with their outcome; each deployment has its own caps.

    A deployment's requests are decided one after the other, so they meet in one task; deployments are spread. For a table
    of requests, whatever their number, take operators.limits.admissions, which is exact and parallel.
    """
    kept = requests.select("deployment", "request_id", "session", "ts").where("deployment is not null and session is not null and ts is not null")
    return kept.groupBy("deployment").transformWithStateInPandas(Admission(session_cap, day_cap), SCHEMA, "Append", "None")
