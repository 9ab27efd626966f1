"""Session rules as keyed state, with liveness timers.

One state row per stream key: gate, open recovery, session, sequence, monitoring start and the time of the
last signal. Only the narrow classified columns enter the operator. The rows of a key are held as packed
columns (some 25 bytes a row, for sorting) and taken and told in slices; the source's rate limit bounds a
micro-batch, and for instruments too hot for one task there is :mod:`feedlake.streaming.folded`.

Time is the stream's own: a key's clock moves with its rows, never with those of other keys, so a key that
lags loses nothing. There is no watermark, hence nothing is dropped before the operator. Rows behind their
own stream are told as ``late`` and change nothing. A silent key's clock is moved by ``tick`` rows, which the
ingest writes for quiet instruments (kind ``tick``, no arrival, the time up to which all is delivered), or,
with ``live``, by processing time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from feedlake.operators.liveness import Monitor
from feedlake.operators.session_state import TRIGGERS

STATE = (
    "is_open boolean, recovering boolean, session bigint, seq bigint, monitor_ns bigint, signal_ns bigint, "
    "last_arrival bigint, time_ns bigint"
)
_FIELDS = [c.split()[0] for c in STATE.split(", ")]
START = (False, False, 0, 0, -1, -1, -1, -1)
OUTPUT = (
    "arrival bigint, kind string, disposition string, open_before boolean, open_after boolean, "
    "attempt boolean, ignored boolean, session_id bigint, gateway_seq bigint, at_ns bigint"
)
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
TICK = "tick"
SLICE = 1 << 13


def in_order(rows: Iterator[pd.DataFrame], numbers: Sequence[str]) -> Iterator[zip]:
    """The rows of a key by arrival (those without one last, in their order), as slices of tuples (arrival, kind,
    *numbers). Rows are packed while they come in: integers and a code for the kind; an absent number is -1."""
    kinds: dict[str, int] = {}
    packed: list[tuple[np.ndarray, ...]] = []
    for chunk in rows:
        codes, names = pd.factorize(chunk["kind"])
        table = np.array([kinds.setdefault(n, len(kinds)) for n in names], np.int16)
        last = np.iinfo(np.int64).max
        arrival = chunk["arrival"].astype("Int64").fillna(last).to_numpy(np.int64)
        packed.append((arrival, table[codes], *(chunk[c].astype("Int64").fillna(-1).to_numpy(np.int64) for c in numbers)))
        del chunk
    columns = []
    for i in range(len(packed[0]) if packed else 0):
        columns.append(np.concatenate([p[i] for p in packed]))
    if not columns:
        return
    packed.clear()
    names = list(kinds)
    order = np.argsort(columns[0], kind="stable")
    for low in range(0, len(order), SLICE):
        at = order[low : low + SLICE]
        arrival, codes, *rest = (c[at].tolist() for c in columns)
        yield zip(arrival, [names[c] for c in codes], *rest, strict=True)


class SessionProcessor(StatefulProcessor):
    """Session state per key; ``timeout_ns`` of None switches liveness off. ``restart`` is the order feed,
    which subscribes again at once after a recovery."""

    def __init__(self, keys: tuple[str, ...], timeout_ns: int | None = None, restart: bool = False, live: bool = False):
        self.keys, self.timeout_ns, self.restart, self.live = keys, timeout_ns, restart, live

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        stored = self.state.get() if self.state.exists() else START
        return dict(zip(_FIELDS, stored, strict=True))

    def _monitor(self, s: dict) -> Monitor:
        monitor = Monitor(self.timeout_ns, self.restart)
        monitor.start, monitor.last = (v if v >= 0 else None for v in (s["monitor_ns"], s["signal_ns"]))
        return monitor

    def _apply(self, s: dict, arrival: int, kind: str, at_ns: int) -> tuple:
        before = s["is_open"]
        invalid = kind in ("snapshot", "bad_snapshot") and before
        trigger = kind in TRIGGERS or invalid
        attempt, ignored = trigger and not s["recovering"], trigger and s["recovering"]
        outcome, publish = kind, False
        if invalid:
            outcome = "duplicate_snapshot"
        elif kind == "snapshot":
            outcome, publish = "accepted_snapshot", True
        elif kind == "bad_snapshot":
            outcome = "rejected"
        elif kind in ("update", "trade", "bad_update") and not before:
            outcome = "pre_snapshot"
        elif kind == "bad_update":
            outcome = "rejected"
        elif kind in ("update", "trade"):
            outcome, publish = "published", True
        if outcome == "accepted_snapshot":
            s.update(is_open=True, recovering=False)
        elif trigger:
            s.update(is_open=False, recovering=True)
        elif kind == "recovery_failed":
            s["recovering"] = False
        if attempt:
            s.update(session=s["session"] + 1, seq=0)
        if publish:
            s["seq"] += 1
        if kind in ("ack", "heartbeat"):
            s["signal_ns"] = at_ns
            if s["monitor_ns"] < 0 and (kind == "ack" or self.restart):
                s["monitor_ns"] = at_ns
        elif attempt or kind == "disconnect":
            s["monitor_ns"] = at_ns if self.restart and s["monitor_ns"] >= 0 else -1
        seq = s["seq"] if publish else None
        return (arrival, kind, outcome, before, s["is_open"], attempt, ignored, s["session"], seq, at_ns)

    def _advance(self, s: dict, limit_ns: int, out: list) -> None:
        """Timeouts before ``limit_ns``; an ignored one sets the clock and may fire again."""
        if self.timeout_ns is None:
            return
        while (hit := self._monitor(s).fire(limit_ns)) is not None:
            s["signal_ns"] = hit[0]
            out.append(self._apply(s, s["last_arrival"], "timeout", hit[0]))

    def _frame(self, key: tuple, out: list) -> pd.DataFrame:
        frame = pd.DataFrame([(*key, *row) for row in out], columns=[*self.keys, *_COLUMNS])
        frame["gateway_seq"] = frame["gateway_seq"].astype("Int64")
        return frame

    def _finish(self, s: dict, now_ms: int | None) -> None:
        self.state.update(tuple(s.values()))
        if self.live:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            check = self._monitor(s).check()
            if check is not None and now_ms is not None:
                self.handle.registerTimer(now_ms + max(0, check - s["time_ns"]) // 1_000_000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        for part in in_order(rows, ["at_ns"]):
            out: list = []
            for arrival, kind, at_ns in part:
                if kind == TICK:
                    self._advance(s, at_ns, out)
                    s["time_ns"] = max(s["time_ns"], at_ns)
                elif arrival <= s["last_arrival"]:
                    # Arrival order is the contract of the stream; a row behind it is counted, not applied.
                    out.append((arrival, kind, "late", s["is_open"], s["is_open"], False, False, s["session"], None, at_ns))
                else:
                    self._advance(s, at_ns, out)
                    out.append(self._apply(s, arrival, kind, at_ns))
                    s["last_arrival"], s["time_ns"] = arrival, max(s["time_ns"], at_ns)
            yield self._frame(key, out)
        self._finish(s, timerValues.getCurrentProcessingTimeInMs() if self.live else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The key has been silent for as long as its next check was away."""
        s, out = self._load(), []
        check = self._monitor(s).check()
        if check is not None:
            self._advance(s, check + 1, out)
            s["time_ns"] = max(s["time_ns"], check)
        self._finish(s, timerValues.getCurrentProcessingTimeInMs())
        yield self._frame(key, out)


def keyed_sessions(
    classified: DataFrame,
    timeout_ns: int | None = None,
    keys: tuple[str, ...] = ("instrument_id",),
    restart: bool = False,
    live: bool = False,
) -> DataFrame:
    """Classified stream to dispositions. Needs ``keys, arrival, kind, at_ns``; several venues share a stream
    with ``keys=("venue", "instrument_id")``.

    With ``live`` a silence also fires when no further row of the key comes, once as much processing time
    has passed since the key's last row as was left to its next check. These timers are part of the state: they
    survive a restart, and fire again from the first micro-batch after it on (Spark starts one with the first
    row of any key).
    """
    narrow = classified.select(*keys, "arrival", "kind", "at_ns")
    output = T.StructType([*narrow.select(*keys).schema.fields, *T.StructType.fromDDL(OUTPUT).fields])
    return narrow.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=SessionProcessor(tuple(keys), timeout_ns, restart, live),
        outputStructType=output,
        outputMode="Append",
        timeMode="ProcessingTime" if live else "None",
    )
