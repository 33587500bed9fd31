"""What happens to a question, as ordered events: stages, the answer's tokens, the final answer.

answer_events makes them from rows of answer_questions, in columns only. event_stream numbers the events of each session
from one question to the next with state, so that a reader can go on where it stopped; a batch that is replayed finds the
state of the batch before it and gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "session long, seq long, qid long, type string, node string, text string"


def answer_events(answers: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(*extra, qid, seq, type, node, text) of answers (qid, route, answer, …): each question's events, seq from 0.

    First a stage event for retrieve; where the score gate let the question pass, one for grade_evidence. If it is
    answered, a token event for each word with the white space after it, and a stage event for generate; if not, a stage
    event for refuse, without tokens. Last a final event with the whole answer. A null answer counts as empty.
    """
    node = lambda name: F.struct(F.lit("stage").alias("type"), F.lit(name).alias("node"), F.lit(None).cast("string").alias("text"))
    answer = F.coalesce("answer", F.lit(""))
    token = lambda t: F.struct(F.lit("token").alias("type"), F.lit("generate").alias("node"), t.alias("text"))
    final = F.struct(F.lit("final").alias("type"), F.lit(None).cast("string").alias("node"), answer.alias("text"))
    passed, made = F.col("route") != "refuse:score_gate", F.col("route") == "generate"
    none = F.array().cast("array<struct<type:string,node:string,text:string>>")
    words = F.transform(F.regexp_extract_all(answer, F.lit(r"(?U)^\s+|\S+\s*"), F.lit(0)), token)
    events = F.concat(F.array(node("retrieve")), F.when(passed, F.array(node("grade_evidence"))).otherwise(none), F.when(made, F.concat(words, F.array(node("generate")))).otherwise(F.array(node("refuse"))), F.array(final))
    rows = answers.select(*(extra or []), "qid", F.posexplode(events).alias("seq", "e"))
    return rows.select(*(extra or []), "qid", F.col("seq").cast("long").alias("seq"), "e.type", "e.node", "e.text")


class _Numbers(StatefulProcessor):
    """The next number of a session's events; questions that were taken before give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.done = handle.getMapState("done", "qid long", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "qid", "seq"], kind="stable")
        at = self.next.get()[0] if self.next.exists() else 0
        found = []
        for qid, own in events.groupby("qid", sort=False):
            if self.done.containsKey((int(qid),)):
                continue
            self.done.updateValue((int(qid),), (at,))
            found.append(own.assign(session=key[0], seq=range(at, at + len(own))))
            at += len(own)
        self.next.update((at,))
        yield pd.concat(found)[["session", "seq", "qid", "type", "node", "text"]] if found else pd.DataFrame(columns=["session", "seq", "qid", "type", "node", "text"])

    def close(self) -> None:
        pass


def event_stream(answers: DataFrame) -> DataFrame:
    """Streaming answers (session, ts, qid, route, answer) to (session, seq, qid, type, node, text), numbered by session.

    A session's questions come in the order of ts within a batch; one that comes again, in a later batch, gives no events.
    Needs the RocksDB state store (admission.STORE).
    """
    events = answer_events(answers.where("session is not null and qid is not null"), ["session", "ts"])
    return events.groupBy("session").transformWithStateInPandas(_Numbers(), SCHEMA, "Append", "None")
