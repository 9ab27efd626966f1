"""Books and resting orders from normalized events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.fixed import fixed_value
from feedlake.operators.ordering import BUCKET, Lane, max_before, running, spread_join, sum_before, sum_upto
from feedlake.operators.session_feed import sessions

ORDER_LANE = Lane(keys=("instrument_id", "order_ref"))


def level_book(levels: DataFrame, *keys: str, pos: str = "arrival", until: int | None = None) -> DataFrame:
    """Current price levels: the last entry per (key, side, price) wins, a DELETE removes.

    Prices compare by value, so the same price at two scales is one level. Pure aggregation: a hot
    instrument is combined map-side before the shuffle. ``until`` gives the book as of a position.
    """
    rows = levels if until is None else levels.where(F.col(pos) <= until)
    priced = rows.withColumn("price", fixed_value(F.col("price_m"), F.col("price_s")))
    state = F.struct("action", "qty_m", "qty_s", "price_m", "price_s")
    last = priced.groupBy(*keys, "side", "price").agg(F.max_by(state, F.struct(pos, "entry_pos")).alias("last"))
    return last.where("last.action = 1").select(
        *keys, "side", "price", *[F.col(f"last.{c}").alias(c) for c in ("price_m", "price_s", "qty_m", "qty_s")]
    )


def session_book(levels: DataFrame, sessions: DataFrame, *keys: str) -> DataFrame:
    """:func:`level_book` of each key's newest session; a reset empties the book.

    ``sessions`` holds the newest ``session_id`` per key, also where nothing was published since.
    """
    newest = sessions.groupBy(*keys).agg(F.max("session_id").alias("_newest"))
    current = spread_join(levels, newest, keys).where(F.col("session_id") == F.col("_newest"))
    return level_book(current, *keys)


def traded_so_far(events: DataFrame, lane: Lane = ORDER_LANE) -> DataFrame:
    """Add ``traded``: size matched against the order up to and including each row."""
    size = F.when(F.col("kind") == "match", F.col("qty"))
    return running(events, lane, traded=sum_upto(size))


def resting_orders(events: DataFrame, lane: Lane = ORDER_LANE, until: int | None = None) -> DataFrame:
    """Open orders with their remaining size.

    ``open`` and ``change`` set the size, ``done`` removes, ``match`` reduces; ``received`` and
    ``activate`` do not touch the book. Remaining = size at the last absolute event minus what was
    traded after it, which is total traded minus traded at that event.
    """
    rows = events if until is None else events.where(F.col(lane.pos) <= until)
    rows = rows.where(F.col("kind").isin("open", "change", "done", "match"))
    swept = traded_so_far(rows, lane)
    absolute = F.col("kind") != "match"
    folded = swept.groupBy(*lane.keys).agg(
        F.max(F.when(absolute, F.struct(F.col(lane.pos), "kind", "qty", "traded"))).alias("last"),
        F.sum(F.when(~absolute, F.col("qty"))).alias("total"),
    )
    after = F.coalesce("total", F.lit(0)) - F.coalesce("last.traded", F.lit(0))
    return folded.where("last.kind <> 'done'").select(
        *lane.keys,
        F.col("last.kind").alias("last_kind"),
        (F.col("last.qty") - after).cast("decimal(18,2)").alias("resting_qty"),
    )


def session_orders(deltas: DataFrame, images: DataFrame, events: DataFrame, lane: Lane = ORDER_LANE) -> DataFrame:
    """:func:`resting_orders` of each key's newest session, where a document replaces the whole book.

    ``deltas`` are the rows that the session sent (``session_id`` from
    :func:`feedlake.operators.session_feed.session_feed`), ``images`` the orders of the documents (keys, order, ``qty``
    and the position of their document, one row per order), ``events`` the feed's events. Orders of earlier
    sessions and those that the document does not list are gone without a row that says so; a session still
    waiting for its document has no book.
    """
    keys = [k for k in lane.keys if k in events.columns]
    named = sessions(events, Lane(tuple(keys), lane.pos))
    newest = named.groupBy(*keys).agg(F.max_by(F.struct("session_id", "accepted_at"), "session_id").alias("_now"))
    live = newest.where("_now.accepted_at is not null").select(*keys, "_now.*")
    followed = spread_join(deltas, live.withColumnRenamed("session_id", "_session"), keys, spread=lane.pos)
    followed = followed.where(F.col("session_id") == F.col("_session"))
    listed = images.join(live.withColumnRenamed("accepted_at", lane.pos), [*keys, lane.pos])
    # Positions are not negative: the document comes before everything that was replayed on it.
    first = listed.select(*lane.keys, F.lit(-1).cast("bigint").alias(lane.pos), F.lit("open").alias("kind"), "qty")
    return resting_orders(followed.select(*lane.keys, lane.pos, "kind", "qty").unionByName(first), lane)


def size_before(events: DataFrame, lane: Lane = ORDER_LANE) -> DataFrame:
    """Add ``current_qty``: the order's remaining size just before each row (NULL = not resting)."""
    size = F.when(F.col("kind") == "match", F.col("qty"))
    swept = running(lane.bucketed(events), lane, _sold=sum_before(size), _sold_now=sum_upto(size))
    absolute = F.col("kind").isin("open", "change", "done")
    state = F.struct(F.col(lane.pos), "kind", "qty", F.col("_sold_now").alias("sold"))
    traced = running(swept, lane, _last=max_before(F.when(absolute, state)))
    last = F.col("_last")
    remaining = last["qty"] - (F.coalesce("_sold", F.lit(0)) - F.coalesce(last["sold"], F.lit(0)))
    return traced.withColumn("current_qty", F.when(last["kind"] != "done", remaining)).drop(
        "_sold", "_sold_now", "_last", BUCKET
    )


def change_conflicts(events: DataFrame, lane: Lane = ORDER_LANE, old: str = "old_qty") -> DataFrame:
    """``change`` rows whose old size differs from the order's current size."""
    traced = size_before(events, lane)
    return traced.where((F.col("kind") == "change") & ~F.col(old).eqNullSafe(F.col("current_qty")))


def maker_fills(events: DataFrame, lane: Lane = ORDER_LANE) -> DataFrame:
    """Each trade with its maker's size before and after it."""
    traced = size_before(events, lane).where("kind = 'match'")
    return traced.withColumn("remaining_qty", F.col("current_qty") - F.col("qty"))
