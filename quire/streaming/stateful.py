"""Streams that carry state of their own: the stage machine, and event frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State stores of ``transformWithState`` need this provider.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StageMachine(StatefulProcessor):
    """Holds the last stage of a key, and tells whether the next may follow."""

    def __init__(self, order: list[str], stage: str, allowed: list[tuple[str, str]], names: list[str]):
        self.order, self.stage, self.allowed, self.names = order, stage, set(allowed), names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("stage", "stage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        stages = events[self.stage].tolist()
        events["from_stage"] = [before, *stages[:-1]]
        events["legal"] = [a is None or (a, b) in self.allowed for a, b in zip(events["from_stage"], stages, strict=True)]
        self.last.update((stages[-1],))
        yield events[[*self.names, "from_stage", "legal"]]

    def close(self) -> None:
        pass


def check_stages(events: DataFrame, key: str, order: list[str], stage: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """The events of a stream with ``from_stage`` (the key's stage before; null
    for its first) and ``legal``: whether the transition is in the table. A
    value state holds each key's stage across micro-batches; within one, events
    go by ``order``. Filter on ``legal`` for a side output of what is not.

    Sets the state store's provider, which ``transformWithState`` needs."""
    events.sparkSession.conf.set(*ROCKSDB)
    names = events.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    machine = StageMachine(order, stage, allowed, names)
    return events.groupBy(key).transformWithStateInPandas(machine, f"{kinds}, from_stage string, legal boolean", "Append", "None")


def frames_of(buffer: bytes) -> tuple[list[str], bytes]:
    """The JSON payloads of all whole frames, and the bytes of the frame that
    isn't whole yet. Frames end at a blank line; a payload is the frame's data
    lines; frames without one, or whose payload is no JSON, are left out."""
    *whole, rest = buffer.split(b"\n\n")
    out = []
    for frame in whole:
        lines = [line[5:].lstrip() for line in frame.decode("utf-8", "replace").split("\n") if line.startswith("data:")]
        try:
            json.loads("\n".join(lines))
        except ValueError:
            continue
        out.append("\n".join(lines))
    return out, rest


def parse_frames(chunks: DataFrame) -> DataFrame:
    """Events of connections: connection, n (from 0), payload (JSON).

    ``chunks`` is a stream of connection, seq and chunk (bytes), cut anywhere,
    even within a character. The state of a connection is the frame that is not
    whole yet and the number of its events; chunks of a micro-batch go by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else (b"", 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        found, rest = frames_of(bytes(rest) + b"".join(rows["chunk"]))
        state.update((rest, n + len(found)))
        yield pd.DataFrame({"connection": pd.Series([key[0]] * len(found), dtype=object), "n": pd.Series(range(n, n + len(found)), dtype="int64"), "payload": pd.Series(found, dtype=object)})

    return chunks.groupBy("connection").applyInPandasWithState(step, "connection string, n long, payload string", "rest binary, n long", "append", GroupStateTimeout.NoTimeout)
