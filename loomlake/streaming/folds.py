"""Stateful folds of event streams by key."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHAT = "request_id long, first_seq long, last_seq long, ended string, answer string, calls array<struct<tool_use_id:string,turn:int,text:string,call:string,result:string>>"

# Workers get these classes with each query, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _micros(at: pd.Timestamp) -> int:
    """Microseconds since 1970; a moment without a time zone is UTC."""
    return (at if at.tzinfo is None else at.tz_convert("UTC").tz_localize(None)).value // 1000


class _Chat(StatefulProcessor):
    """One request: the text since its last call and the turn as a value, its calls and results as a map."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.talk = handle.getValueState("talk", "first_seq long, last_seq long, text string, turn int, called boolean, rings long")
        self.calls = handle.getMapState("calls", "tool_use_id string", "n int, turn int, text string, call string, result string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        # State is read once and written once for all rows of the batch.
        talk, calls = self._read()
        self._clear(talk)
        out = []
        for seq, event, data, use in zip(new["seq"], new["event"], new["data"], new["tool_use_id"]):
            talk = talk or [int(seq), int(seq), "", 1, False, 0]
            talk[1] = int(seq)
            if event == "message":
                # Text after a call belongs to the next turn.
                talk[2], talk[3], talk[4] = talk[2] + (data or ""), talk[3] + int(talk[4]), False
            elif event == "toolCall":
                call = calls.setdefault(use, [len(calls), None, None, None, None])
                call[1:4] = talk[3], talk[2], data
                talk[2], talk[4] = "", True
            elif event == "toolCallResult":
                calls.setdefault(use, [len(calls), None, None, None, None])[4] = data
            else:
                out.append((talk, calls, event))
                talk, calls = None, {}
        self._keep(talk, calls, timerValues)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        talk, calls = self._read()
        if talk:
            self._clear(None)
            yield self._rows(key, [(talk, calls, "timeout")])

    def _read(self) -> tuple[list | None, dict]:
        if not self.talk.exists():
            return None, {}
        return list(self.talk.get()), {k[0]: list(v) for k, v in self.calls.iterator()}

    def _clear(self, talk: list | None) -> None:
        self.talk.clear()
        self.calls.clear()
        if talk:
            self.handle.deleteTimer(talk[5])

    def _keep(self, talk: list | None, calls: dict, timers) -> None:
        if talk:
            talk[5] = timers.getCurrentProcessingTimeInMs() + self.idle_ms
            self.talk.update(tuple(talk))
            for use, call in calls.items():
                self.calls.updateValue((use,), tuple(call))
            self.handle.registerTimer(talk[5])

    @staticmethod
    def _rows(key: tuple, ended: list) -> pd.DataFrame:
        names = ("tool_use_id", "turn", "text", "call", "result")
        listed = [[dict(zip(names, (use, *call[1:]))) for use, call in sorted(calls.items(), key=lambda c: c[1][0])] for _, calls, _ in ended]
        columns = ("first_seq", "last_seq")
        return pd.DataFrame({"request_id": [key[0]] * len(ended), **{c: [talk[i] for talk, _, _ in ended] for i, c in enumerate(columns)}, "ended": [e for _, _, e in ended], "answer": [talk[2] for talk, _, _ in ended], "calls": listed})


def fold_chat(events: DataFrame, idle_seconds: float = 600) -> DataFrame:
    """Each request once it has ended: the answer (text after its last call) and its calls with their turns, ids and results.

    ``events``: request_id, seq (unique in a request), event, data, tool_use_id.  A request ends with a ``done`` or ``error`` event, or when none
    has come for ``idle_seconds`` (``ended`` is 'timeout'); what it had said and called until then is kept in the row, and its state
    is freed.  Events of a request have to come in order of ``seq`` from batch to batch; within a batch any order is fine.  Later events
    under the same id begin a new row.  A result whose call isn't there has no call.  Needs the RocksDB state store (``with_rocksdb``).
    """
    return events.groupBy("request_id").transformWithStateInPandas(_Chat(int(idle_seconds * 1000)), CHAT, "Update", "ProcessingTime")


DELIVERY = "message_id long, attempts long, state string, version long"


class _Deliveries(StatefulProcessor):
    """One message: attempts, when the last one was, whether it was acknowledged, and how often its row has changed."""

    def __init__(self, idle_seconds: int, most: int, forget_seconds: int) -> None:
        self.idle, self.most, self.forget = idle_seconds * 1000, most, forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "attempts long, last_ms long, acked boolean, version long, rings long", ttlDurationMs=self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        attempts, last, acked, version, rings = self.seen.get() if self.seen.exists() else (0, 0, False, 0, None)
        attempts, acked = attempts + len(new), bool(acked or new["acked"].any())
        last = max(last, _micros(new["attempt_ts"].max()) // 1000)
        if rings is not None:
            self.handle.deleteTimer(rings)
        # Rings once the message has been idle for long enough, at once if it has been already.
        rings = None if acked else last + self.idle
        if rings is not None:
            self.handle.registerTimer(rings)
        yield self._row(key, (attempts, last, acked, version + 1, rings), "done" if acked else "pending")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            attempts, last, acked, version, _ = self.seen.get()
            if not acked:
                yield self._row(key, (attempts, last, acked, version + 1, None), "dropped" if attempts >= self.most else "reclaimable")

    def _row(self, key: tuple, seen: tuple, state: str) -> pd.DataFrame:
        self.seen.update(seen)
        return pd.DataFrame({"message_id": [key[0]], "attempts": [seen[0]], "state": [state], "version": [seen[3]]})


def fold_deliveries(log: DataFrame, idle_seconds: int = 120, most: int = 5, forget_seconds: int = 30 * 86_400) -> DataFrame:
    """Changes of messages' states as attempts come and time passes: message_id, attempts, state, version (grows with each change).

    ``log``: message_id, attempt_ts, acked.  An acknowledged message is done, others are pending until the last attempt is
    ``idle_seconds`` ago by the clock; then they are reclaimable, or dropped after ``most`` attempts.  Attempts may come in any order.
    What is known of a message is freed ``forget_seconds`` after its last change.  Needs the RocksDB state store.
    """
    return log.groupBy("message_id").transformWithStateInPandas(_Deliveries(idle_seconds, most, forget_seconds), DELIVERY, "Update", "ProcessingTime")


def with_rocksdb(events: DataFrame) -> DataFrame:
    """The same table; its session keeps streaming state in RocksDB from now on, on disk and not in the heap."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events


def throttle(uses: DataFrame, seconds: int = 300) -> DataFrame:
    """(user_id, micros) of uses kept: at least so long after the user's last kept one; one number of state for each user."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for at in sorted(pd.concat(list(batches))["micros"].tolist()):
            if last is None or at >= last + seconds * 1_000_000:
                kept.append(at)
                last = at
        if kept:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "micros": kept})

    return uses.groupBy("user_id").applyInPandasWithState(fold, "user_id long, micros long", "last long", "append", GroupStateTimeout.NoTimeout)
