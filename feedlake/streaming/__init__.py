"""Structured Streaming forms of the session rules."""

from feedlake.streaming.accounting import accumulate, each, read_totals
from feedlake.streaming.book import latest_orders, stream_orders
from feedlake.streaming.feed import feed_messages
from feedlake.streaming.folded import fold_batches, resume_session_rules
from feedlake.streaming.keyed import keyed_sessions
from feedlake.streaming.sink import read_messages, start_keyed, write_messages, write_once

__all__ = [
    "accumulate",
    "each",
    "feed_messages",
    "fold_batches",
    "keyed_sessions",
    "latest_orders",
    "read_messages",
    "read_totals",
    "resume_session_rules",
    "start_keyed",
    "stream_orders",
    "write_messages",
    "write_once",
]
