"""Price-level frames: classification and flattening.

Every frame gets one ``kind``; nothing is dropped here, so that the frame counters stay complete.

====================  =====================================================================
``snapshot``          well-formed full book image
``bad_snapshot``      full book image with a bad level, a missing side or too many entries
``update``            well-formed incremental update
``bad_update``        incremental update with a bad change or too many entries
``heartbeat``         heartbeat of this instrument
``ack`` / ``trigger`` valid / invalid subscription acknowledgement
``mismatch``          frame of another (or no) product
``unknown``           unknown frame type
``malformed``         no frame type
====================  =====================================================================
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.binding import let
from feedlake.functions.fixed import fixed_point
from feedlake.functions.jsontext import (
    first_object_named,
    json_array,
    json_string,
    quoted_groups,
    quoted_strings,
)
from feedlake.functions.times import rfc3339_nanos
from feedlake.functions.wirecodes import MAX_ENTRIES

LEVEL_COLUMNS = ("side", "action", "price_m", "price_s", "qty_m", "qty_s")
ACK_CHANNELS = ("level2", "heartbeat")


def _level(side: Column, action: Column, price: Column, qty: Column) -> Column:
    return F.struct(
        side.cast("int").alias("side"),
        action.cast("int").alias("action"),
        price["m"].alias("price_m"),
        price["s"].alias("price_s"),
        qty["m"].alias("qty_m"),
        qty["s"].alias("qty_s"),
    )


def _all_usable(levels: Column, usable) -> Column:
    """One bad level rejects the message."""
    return let(levels, lambda found: F.when(F.forall(found, usable), found))


def _priced(level: Column) -> Column:
    return level["price_m"].isNotNull() & level["qty_m"].isNotNull()


def snapshot_levels(payload: Column) -> Column:
    """Bids then asks, always UPSERT; NULL rejects the frame. Both sides are required, each may be empty."""

    def one(key: str, side: int) -> Column:
        def build(price: Column, size: Column) -> Column:
            return _level(F.lit(side), F.lit(1), fixed_point(price), fixed_point(size))

        return quoted_groups(json_array(payload, key), 2, build)

    return _all_usable(F.concat(one("bids", 1), one("asks", 2)), _priced)


def update_levels(payload: Column) -> Column:
    """``[side, price, size]`` changes in order: zero size deletes, negative size rejects."""

    def build(side: Column, price: Column, size: Column) -> Column:
        code = F.when(side == "buy", 1).when(side == "sell", 2)
        return let(
            fixed_point(size),
            lambda qty: _level(code, F.when(qty["m"] == 0, 2).otherwise(1), fixed_point(price), qty),
        )

    return _all_usable(
        quoted_groups(json_array(payload, "changes"), 3, build),
        lambda x: _priced(x) & x["side"].isNotNull() & (x["qty_m"] >= 0),
    )


def ack_valid(payload: Column, symbol: Column, channels=ACK_CHANNELS) -> Column:
    """The first channel object of each required name must list the symbol."""

    def listed(text: Column) -> Column:
        products = [quoted_strings(json_array(first_object_named(text, channel), "product_ids")) for channel in channels]
        return reduce(and_, [F.array_contains(names, symbol) for names in products])

    return F.coalesce(let(json_array(payload, "channels"), listed), F.lit(False))


def classify_l2(frames: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Add ``frame_type, product_id, levels, entry_count, over_cap, exchange_ns, kind``.

    ``frames`` needs ``payload`` and the instrument's ``symbol``; a frame with ``payload_bin`` set is a
    binary frame, which is of unknown type.
    """
    payload, symbol = F.col("payload"), F.col("symbol")
    binary = F.col("payload_bin").isNotNull() if "payload_bin" in frames.columns else F.lit(False)
    typed = frames.select(
        "*", json_string(payload, "type").alias("frame_type"), json_string(payload, "product_id").alias("product_id")
    )
    ours = F.coalesce(F.col("product_id") == symbol, F.lit(False))
    parsed = typed.select(
        "*",
        let(
            F.when(ours, F.col("frame_type")),
            lambda t: F.when(t == "snapshot", snapshot_levels(payload)).when(t == "l2update", update_levels(payload)),
        ).alias("_levels"),
    )
    counted = parsed.select("*", F.coalesce(F.size("_levels"), F.lit(-1)).alias("_n"))

    def kind_of(head: Column) -> Column:
        kind, good = head["t"], head["n"].between(0, max_entries)
        return (
            F.when(head["binary"], "unknown")
            .when(kind.isNull(), "malformed")
            .when(
                kind == "subscriptions",
                F.when(ack_valid(payload, symbol), F.lit("ack")).otherwise(F.lit("trigger")),
            )
            .when(~kind.isin("snapshot", "l2update", "heartbeat"), "unknown")
            .when(~head["ours"], "mismatch")
            .when(kind == "heartbeat", "heartbeat")
            .when(kind == "snapshot", F.when(good, F.lit("snapshot")).otherwise(F.lit("bad_snapshot")))
            .otherwise(F.when(good, F.lit("update")).otherwise(F.lit("bad_update")))
        )

    head = F.struct(
        F.col("frame_type").alias("t"), ours.alias("ours"), F.col("_n").alias("n"), binary.alias("binary")
    )
    good = F.col("_n").between(0, max_entries)
    time = F.coalesce(rfc3339_nanos(json_string(payload, "time")), F.lit(-1))
    return counted.select(
        *typed.columns,
        F.when(good, F.col("_levels")).alias("levels"),
        (F.col("_n") > max_entries).alias("over_cap"),
        F.when(good, F.col("_n")).otherwise(F.lit(0)).alias("entry_count"),
        F.when(good, time.cast("bigint")).alias("exchange_ns"),
        let(head, kind_of).alias("kind"),
    )


def flatten_levels(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per price level, ``entry_pos`` from 0 in message order."""
    # The outer form keeps the optimizer from repeating the whole parse in an inferred filter.
    rows = messages.select(*keep, F.posexplode_outer("levels").alias("entry_pos", "level"))
    return rows.where("entry_pos is not null").select(
        *keep, "entry_pos", *[F.col(f"level.{c}").alias(c) for c in LEVEL_COLUMNS]
    )
