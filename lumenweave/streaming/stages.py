"""The stages of a run as a stream: what state each is in, whatever the order and however often its events come.

Events of a medium are kept by dispatch and stage in the state store, only the one that
counts of each; so a repeated event changes nothing, and an event that comes late takes
the place it would have had. :func:`stage_table` is the same of a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an event has. A ``dispatched`` event names the run that counts from then on; the others are of a stage.
EVENT = "media_id long, dispatch_id string, stage string, status string, at timestamp, event_id long"
TERMINAL = ("completed", "failed")
#: ``state``: running, completed, failed, or stalled if a stage runs and nothing is heard of it.
OUT = "media_id long, dispatch_id string, stage string, state string, at timestamp, event_id long"


def _counts(status: str, at: pd.Timestamp, event_id: int) -> tuple:
    """Of a stage's events the largest counts: one that ends it before any that don't, then the later."""
    return status in TERMINAL, at, event_id


class StageStates(StatefulProcessor):
    """Hands on the stages of a medium's current dispatch that have changed; ``silent`` ms after its last event a running one is stalled."""

    def __init__(self, silent: int) -> None:
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dispatch = handle.getValueState("dispatch", "dispatch_id string, at timestamp, event_id long")
        self.stages = handle.getMapState("stages", "dispatch_id string, stage string", "state string, at timestamp, event_id long")

    def _rows(self, key: tuple, changed: set, stalled: int | None = None) -> list[tuple]:
        current = self.dispatch.get()
        if current is None:
            return []
        out = []
        for (dispatch, stage), (state, at, event_id) in self.stages.iterator():
            if dispatch != current[0] or stalled is None and (dispatch, stage) not in changed and changed != {None}:
                continue
            if stalled is not None:
                if state in TERMINAL or int(pd.Timestamp(at).timestamp() * 1000) + self.silent > stalled:
                    continue
                state = "stalled"
            out.append((key[0], dispatch, stage, state, at, event_id))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changed: set = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.status == "dispatched":
                    held = self.dispatch.get()
                    if held is None or (r.at, r.event_id) > (pd.Timestamp(held[1]), held[2]):
                        if held is None or held[0] != r.dispatch_id:
                            changed = {None}  # all stages of another dispatch
                        self.dispatch.update((r.dispatch_id, r.at.to_pydatetime(), int(r.event_id)))
                    continue
                place = (r.dispatch_id, r.stage)
                held = self.stages.getValue(place) if self.stages.containsKey(place) else None
                if held is None or _counts(r.status, r.at, r.event_id) > _counts(held[0], pd.Timestamp(held[1]), held[2]):
                    self.stages.updateValue(place, (r.status, r.at.to_pydatetime(), int(r.event_id)))
                    if changed != {None}:
                        changed.add(place)
                    if r.status not in TERMINAL:
                        self.handle.registerTimer(int(r.at.timestamp() * 1000) + self.silent)
        out = self._rows(key, changed) if changed else []
        yield pd.DataFrame(out, columns=["media_id", "dispatch_id", "stage", "state", "at", "event_id"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = self._rows(key, set(), expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame(out, columns=["media_id", "dispatch_id", "stage", "state", "at", "event_id"])

    def close(self) -> None:
        pass


def stage_stream(events: DataFrame, silent: int, late: str) -> DataFrame:
    """Changes of the stages of each medium's current dispatch, as a stream in update mode; needs the RocksDB state store.

    Events of another dispatch are kept, in case it becomes the current one, and not
    handed on. Events later than ``late`` are left out.
    """
    rows = events.select("media_id", "dispatch_id", "stage", "status", "at", "event_id").withWatermark("at", late)
    return rows.groupBy("media_id").transformWithStateInPandas(StageStates(silent), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def stage_table(events: DataFrame, silent: int | None = None, now: str | None = None) -> DataFrame:
    """The states of a finished table of events; with ``silent`` and ``now`` a running stage may be stalled."""
    current = events.where("status = 'dispatched'").groupBy("media_id").agg(F.max_by("dispatch_id", F.struct("at", "event_id")).alias("dispatch_id"))
    rows = events.where("status <> 'dispatched'").join(current, ["media_id", "dispatch_id"])
    place = F.struct(F.col("status").isin(*TERMINAL), "at", "event_id")
    best = rows.groupBy("media_id", "dispatch_id", "stage").agg(F.max_by(F.struct(F.col("status").alias("state"), "at", "event_id"), place).alias("x")).select("media_id", "dispatch_id", "stage", "x.*")
    if silent is not None:
        quiet = F.unix_millis("at") + silent <= F.unix_millis(F.lit(now).cast("timestamp"))
        best = best.withColumn("state", F.when(~F.col("state").isin(*TERMINAL) & quiet, "stalled").otherwise(F.col("state")))
    return best


def latest_changes(changes: DataFrame) -> DataFrame:
    """The table that a log of changes (with ``batch``) leads to: of each medium's last dispatch the last change of each stage."""
    w = Window.partitionBy("media_id").orderBy(F.desc("batch"), F.desc("at"), F.desc("event_id"))
    current = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("media_id", "dispatch_id")
    own = changes.join(current, ["media_id", "dispatch_id"])
    one = Window.partitionBy("media_id", "stage").orderBy(F.desc("batch"), F.desc(F.col("state") == "stalled"))
    return own.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("media_id", "dispatch_id", "stage", "state", "at", "event_id")
