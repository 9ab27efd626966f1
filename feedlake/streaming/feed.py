"""The order feed as a stream: alignment, sessions and recovery as keyed state.

The state of a key is the machine of :mod:`feedlake.operators.session_feed` itself, with the deltas that wait for
a document inside (never more than the buffer's slots). Deltas and documents come as one stream. A
document that is accepted releases its message and the waiting deltas that follow it without a hole; live
deltas pass at once; an applied recovery is a reset message. The messages are those of the batch form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from feedlake.operators.bucketfold import State
from feedlake.operators.session_feed import DELTAS, FeedRules
from feedlake.streaming.keyed import TICK, in_order

OUTPUT = "session_id bigint, event_type int, gateway_seq bigint, seq1 bigint, arrival bigint, cause string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
RESET, SNAPSHOT, UPDATE, TRADE = 1, 2, 3, 4


class FeedProcessor(StatefulProcessor):
    def __init__(self, keys: tuple[str, ...], rules: FeedRules):
        self.keys, self.rules = keys, rules

    def init(self, handle) -> None:
        self.state = handle.getValueState("feed", "fields string, session bigint, sent bigint, last_arrival bigint")

    def close(self) -> None:
        pass

    def _take(self, machine: State, sent: int, pos: int, row: tuple, out: list) -> int:
        """One row; the messages that it releases."""
        waiting = machine.fields["ring"]
        for event in self.rules.step(machine, pos, row):
            at, session, name, cause, applied, _, _, boundary, live, gap = event
            if applied:
                sent = 0
                out.append((session, RESET, 0, 0, at, cause))
            elif name == "snapshot":
                sent = 1
                out.append((session, SNAPSHOT, 1, boundary, at, None))
                for p, seq, trade in waiting:
                    if live is not None and live <= p and (gap is None or p < gap):
                        sent += 1
                        out.append((session, TRADE if trade else UPDATE, sent, seq, p, None))
        kind, _, seq = row
        if kind in DELTAS and machine.fields["open"]:
            sent += 1
            out.append((machine.sessions, TRADE if kind == "trade" else UPDATE, sent, seq, pos, None))
        return sent

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fields, session, sent, last = self.state.get() if self.state.exists() else (None, 0, 0, -1)
        machine = State(json.loads(fields) if fields else self.rules.initial())
        machine.sessions = session
        for part in in_order(rows, ["at_ns", "seq"]):
            out: list = []
            for arrival, kind, at_ns, seq in part:
                if kind == TICK:
                    sent = self._take(machine, sent, last + 1, (TICK, at_ns, None), out)
                elif arrival > last:  # rows behind their own stream change nothing
                    sent = self._take(machine, sent, arrival, (kind, at_ns, seq), out)
                    last = arrival
            frame = pd.DataFrame([(*key, *row) for row in out], columns=[*self.keys, *_COLUMNS])
            yield frame
        self.state.update((json.dumps(machine.fields), machine.sessions, sent, last))


def feed_messages(stream: DataFrame, rules: FeedRules, keys: tuple[str, ...] = ("instrument_id",)) -> DataFrame:
    """Messages ``(keys, session_id, event_type, gateway_seq, seq1, arrival, cause)`` of a stream of ``keys, arrival, kind,
    at_ns, seq``; ``tick`` rows (no arrival) move a silent key's clock."""
    narrow = stream.select(*keys, "arrival", "kind", "at_ns", "seq")
    output = T.StructType([*narrow.select(*keys).schema.fields, *T.StructType.fromDDL(OUTPUT).fields])
    return narrow.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FeedProcessor(tuple(keys), rules), outputStructType=output, outputMode="Append", timeMode="None"
    )
