"""Feed registry: which operators turn a venue's frames into rows.

A feed is a plain record of callables; adding one needs nothing but :func:`register_feed`. The sink side
is just as open: any ``(DataFrame, batch_id)`` callable works as a streaming sink.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from feedlake.operators.l2 import classify_l2, flatten_levels
from feedlake.operators.l3 import classify_l3, flatten_rest_book, order_events, trades


@dataclass(frozen=True)
class Feed:
    """``classify`` frames, ``rows`` by table name, and the book documents a gate may open on."""

    venue: int
    depth: int
    template: int
    classify: Callable[[DataFrame], DataFrame]
    rows: dict[str, Callable[..., DataFrame]]
    documents: Callable[..., DataFrame] | None = None


FEEDS: dict[str, Feed] = {
    "COINBASE_L2": Feed(1, 2, 1, classify_l2, {"book_levels": flatten_levels}),
    "COINBASE_L3": Feed(2, 3, 2, classify_l3, {"order_events": order_events, "trades": trades}, flatten_rest_book),
}


def register_feed(name: str, feed: Feed) -> None:
    """Add a feed; two feeds of one name are an error."""
    if name in FEEDS:
        raise ValueError(f"feed {name} is already registered")
    FEEDS[name] = feed
