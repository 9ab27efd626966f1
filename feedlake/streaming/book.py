"""Resting orders as keyed state: the book of each instrument's newest session, kept while messages arrive.

One map per key holds the open orders; only the orders that a micro-batch touches are read and written. A
``reset`` row empties the book, a ``document`` row begins one anew (its orders follow as ``open`` rows), the other
kinds are those of :func:`feedlake.operators.book.resting_orders`. The stream tells changes: the newest version
of an order is its state, and one without a kind is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from feedlake.streaming.keyed import in_order

OUTPUT = "order_ref bigint, last_kind string, resting bigint, version bigint"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
EMPTYING = ("reset", "document")


class BookProcessor(StatefulProcessor):
    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def init(self, handle) -> None:
        self.orders = handle.getMapState("orders", "order_ref bigint", "kind string, resting bigint")
        self.place = handle.getValueState("place", "last_arrival bigint")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A book from a batch table: the rows of the key's open orders and the position that they stand for."""
        for ref, kind, resting in zip(initialState["order_ref"], initialState["kind"], initialState["resting"], strict=True):
            if kind is not None and not pd.isna(ref):
                self.orders.updateValue((int(ref),), (kind, int(resting)))
        self.place.update((int(initialState["last_arrival"].max()),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (last,) = self.place.get() if self.place.exists() else (-1,)
        cache: dict[int, tuple | None] = {}

        def order(ref: int) -> tuple | None:
            if ref not in cache:
                cache[ref] = self.orders.getValue((ref,)) if self.orders.containsKey((ref,)) else None
            return cache[ref]

        changed: dict[int, int] = {}
        for part in in_order(rows, ["order_ref", "qty"]):
            for arrival, kind, ref, qty in part:
                if arrival <= last:  # behind its stream
                    continue
                last = arrival
                if kind in EMPTYING:
                    known = {k for (k,) in self.orders.keys()} | {r for r, held in cache.items() if held is not None}
                    cache.update(dict.fromkeys(known))
                    changed.update(dict.fromkeys(known, arrival))
                    continue
                if kind in ("open", "change"):
                    cache[ref] = (kind, qty)
                elif kind == "done":
                    cache[ref] = None
                elif kind == "match" and (held := order(ref)) is not None:
                    cache[ref] = (held[0], held[1] - qty)
                else:
                    continue
                changed[ref] = arrival
        for ref in changed:
            if cache[ref] is None:
                if self.orders.containsKey((ref,)):
                    self.orders.removeKey((ref,))
            else:
                self.orders.updateValue((ref,), cache[ref])
        self.place.update((last,))
        out = [(*key, ref, *(cache[ref] or (None, None)), version) for ref, version in changed.items()]
        frame = pd.DataFrame(out, columns=[*self.keys, *_COLUMNS])
        frame["resting"] = frame["resting"].astype("Int64")
        yield frame


def stream_orders(stream: DataFrame, keys: tuple[str, ...] = ("instrument_id",), initial: DataFrame | None = None) -> DataFrame:
    """Changes ``(keys, order_ref, last_kind, resting, version)`` of a stream of ``keys, arrival, kind, order_ref, qty`` (an integer
    of fixed scale). ``initial`` may bring the books to start from: ``keys, order_ref, kind, resting, last_arrival``."""
    narrow = stream.select(*keys, "arrival", "kind", F.col("order_ref").cast("bigint"), F.col("qty").cast("bigint"))
    output = T.StructType([*narrow.select(*keys).schema.fields, *T.StructType.fromDDL(OUTPUT).fields])
    return narrow.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=BookProcessor(tuple(keys)),
        outputStructType=output,
        outputMode="Append",
        timeMode="None",
        initialState=initial.groupBy(*keys) if initial is not None else None,
    )


def latest_orders(changes: DataFrame, *keys: str) -> DataFrame:
    """The books that a table of changes amounts to."""
    last = changes.groupBy(*keys, "order_ref").agg(F.max_by(F.struct("last_kind", "resting"), "version").alias("_last"))
    return last.select(*keys, "order_ref", "_last.*").where("last_kind is not null")
