"""Names of the one-byte codes and the size rule of a message."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire codes. Once assigned they never change.
CODES: dict[str, dict[int, str]] = {
    "venue": {
        1: "COINBASE_L2",
        2: "COINBASE_L3",
        3: "BINANCE_L2",
        4: "BINANCE_L3",
        5: "KRAKEN_L2",
        6: "OKX_L2",
        7: "OKX_L3",
        8: "BYBIT_L2",
    },
    "depth": {1: "L1", 2: "L2", 3: "L3"},
    "template": {1: "BOOK_LEVEL", 2: "ORDER_EVENT", 3: "TRADE_EVENT"},
    "event": {1: "BOOK_RESET", 2: "BOOK_SNAPSHOT", 3: "BOOK_UPDATE", 4: "BOOK_TRADE"},
    "side": {1: "BID", 2: "ASK"},
    "action": {1: "UPSERT", 2: "DELETE"},
    "order_type": {0: "UNKNOWN", 1: "LIMIT", 2: "MARKET", 3: "STOP"},
    "reason": {
        0: "RECEIVED",
        1: "OPEN",
        2: "TRIGGERED",
        3: "MODIFIED",
        4: "FILLED",
        5: "CANCELLED",
        6: "EXPIRED",
        7: "REJECTED",
        8: "DELETE",
    },
    "request_type": {1: "RESET", 2: "RESNAPSHOT", 3: "RESYNC"},
    "request_reason": {
        1: "STREAM_INTEGRITY_FAILURE",
        2: "OUT_OF_ORDER_OR_INVALID_TRANSITION",
        3: "STATE_CORRUPTION",
        4: "CHECK_FAILED",
        5: "HEARTBEAT_TIMEOUT",
        6: "MANUAL_RESET",
    },
}

# Bytes before the repeating group, bytes per entry by template, most entries allowed.
PREFIX_BYTES = 59
ENTRY_BYTES = {1: 20, 2: 55, 3: 51}
MAX_ENTRIES = 10_000


def _lookup(pairs, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)]), key)


def decode_code(family: str, code: Column) -> Column:
    """Name of a code byte, NULL when unknown."""
    return _lookup(CODES[family].items(), code.cast("int"))


def encode_code(family: str, name: Column) -> Column:
    """Code byte of a name, NULL when unknown."""
    return _lookup(((v, k) for k, v in CODES[family].items()), name)


def encoded_size(template: Column, entries: Column) -> Column:
    """Message length in bytes for ``entries`` entries of a template."""
    return F.lit(PREFIX_BYTES) + entries.cast("bigint") * _lookup(ENTRY_BYTES.items(), template.cast("int"))


def venue_key(name: Column) -> Column:
    """Lower-case venue family: the text before the first underscore."""
    return F.lower(F.substring_index(name, "_", 1))
