"""All registered queries and their SQL oracles."""

from __future__ import annotations

from feedlake.plans import books, hard_frames, level_feed, merged_feed, messages, order_feed, scalars, streams

_FAMILIES = tuple(m.FAMILY for m in (level_feed, hard_frames, order_feed, merged_feed, books, messages, scalars, streams))

QUERIES = {name: query for family in _FAMILIES for name, query in family.queries.items()}
SQL = {name: sql for family in _FAMILIES for name, sql in family.sql.items()}
