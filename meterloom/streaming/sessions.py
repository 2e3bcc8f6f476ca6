"""The parser as a stateful stream operator: records in, events out, one small state a session.

The state of a session is what carry.STATE holds, and an epoch that counts how often its file was read anew. It lives in
the state store of the query, so a batch needs its own lines only. The rules are those of operators.events, applied
record by record in file order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterloom.schemas import COUNTERS, DEFAULT_MODEL, EVENTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "carried array<bigint>, model string, spawned boolean, past_boundary boolean, fork_us bigint, epoch int"
_OUT = f"{EVENTS}, epoch int, is_event boolean"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Session:
    """What one session carries; take() gives the event of a record, if it is one."""

    def __init__(self, epoch: int = 0):
        self.carried, self.model, self.spawned, self.past_boundary, self.fork, self.epoch = [0] * 5, None, False, False, None, epoch

    def restore(self, row: tuple) -> Session:
        self.carried, self.model, self.spawned, self.past_boundary, self.fork, self.epoch = list(row[0]), *row[1:]
        return self

    def saved(self) -> tuple:
        return self.carried, self.model, self.spawned, self.past_boundary, self.fork, self.epoch

    def take(self, kind: str, at: int | None, model: str | None, last: list | None, total: list | None, message: list | None, spawned: bool, boundary: bool, fork: int | None) -> list | None:
        """[model, is_fallback, counters] of the event at the time at (microseconds)."""
        self.spawned |= spawned  # only a first record says so
        self.past_boundary |= boundary
        self.fork = fork if self.fork is None else self.fork
        counts = None
        if kind == "usage":
            own = last if last is not None else total and [max(0, t - c) for t, c in zip(total, self.carried, strict=True)]
            if own is not None:
                own = [*own[:4], own[4] if own[4] > 0 else own[0] + own[2]]
                counts = [own[0], min(own[1], own[0]), *own[2:]]
            if total is not None:
                self.carried = list(total)
            elif last is not None:
                self.carried = [c + s for c, s in zip(self.carried, own, strict=True)]
            if counts and not any(counts[:4]):
                counts = None
        elif kind == "message" and message[0] + message[2] > 0:
            counts = message
        if model is not None and (counts or kind == "context"):
            self.model = model
        if not counts or at is None or (self.spawned and not self.past_boundary) or (self.fork is not None and at < self.fork):
            return None
        return [self.model or DEFAULT_MODEL, self.model is None, *counts]


class EventProcessor(StatefulProcessor):
    """Events of sorted records of each session, and a row without an event for each new epoch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Session().restore(self.state.get()) if self.state.exists() else Session()
        found = []
        batch = pd.concat(list(rows)).sort_values("seq")
        if batch["reset"].any():
            session = Session(session.epoch + 1)
            found.append([key[0], -1, None, None, None, *[None] * 5, session.epoch, False])
        for r in batch.itertuples(index=False):
            whole = lambda x: None if x is None else [int(v) for v in x]
            number = lambda x: None if pd.isna(x) else int(x)
            event = session.take(r.kind, number(r.at_us), r.model, whole(r.last), whole(r.cumulative), whole(r.message), bool(r.is_spawned), bool(r.is_boundary), number(r.fork_us))
            if event:
                found.append([key[0], int(r.seq), pd.Timestamp(int(r.at_us), unit="us"), *event, session.epoch, True])
        self.state.update(session.saved())
        out = pd.DataFrame(found, columns=["session_id", "seq", "ts", "model", "is_fallback", *COUNTERS, "epoch", "is_event"])
        yield out.astype({"seq": "int64", "epoch": "int32", "is_event": "bool", "is_fallback": "boolean", "ts": "datetime64[us]", **{c: "Int64" for c in COUNTERS}})

    def close(self) -> None:
        pass


def session_events(records: DataFrame) -> DataFrame:
    """Events (schemas.EVENTS, epoch, is_event) of a stream of records with reset: whether their file was begun anew, which
    all records of a session in a batch share. A row with is_event false says that earlier epochs of its session are void."""
    flat = lambda c: F.when(F.col(c).isNotNull(), F.array(*[F.col(f"{c}.{k}") for k in COUNTERS])).alias(c)
    rows = records.select(
        "session_id", "seq", "reset", F.unix_micros("ts").alias("at_us"), "kind", "model", flat("last"), flat("cumulative"), flat("message"),
        "is_spawned", "is_boundary", F.unix_micros("fork_ts").alias("fork_us"),
    )
    return rows.groupBy("session_id").transformWithStateInPandas(EventProcessor(), _OUT, "append", "none")
