"""Order-by-order frames: classification, order-event and trade rows, book documents.

Kinds as in :mod:`feedlake.operators.l2`, plus ``trade`` (a well-formed match) and ``error`` (an error
frame, which asks for recovery). A missing product makes the frame ``malformed`` here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.binding import let
from feedlake.functions.fixed import MAX_MANTISSA, fixed_point
from feedlake.functions.ids import is_uuid, uuid_halves
from feedlake.functions.jsontext import (
    json_array,
    json_long_prefix,
    json_long_strict,
    json_raw,
    json_string,
    quoted_groups,
)
from feedlake.functions.times import rfc3339_nanos
from feedlake.functions.wirecodes import MAX_ENTRIES
from feedlake.operators.l2 import ack_valid

ORDER_TYPES = ("received", "open", "done", "activate", "change")
ACK_CHANNELS = ("full", "heartbeat")

# Scalar fields and the frame types that read them; other frames are not scanned for the key.
_STRINGS = {
    "time": (*ORDER_TYPES, "match"),
    "side": (*ORDER_TYPES, "match"),
    "order_id": ORDER_TYPES,
    "order_type": ("received",),
    "reason": ("done",),
    "maker_order_id": ("match",),
    "taker_order_id": ("match",),
}
_RAW = {
    "sequence": (*ORDER_TYPES, "match"),
    "price": ("received", "open", "done", "change", "match"),
    "size": ("received", "match"),
    "remaining_size": ("open", "done"),
    "cancel_reason": ("done",),
    "stop_price": ("activate",),
    "new_size": ("change",),
    "old_size": ("change",),
}

EVENT_COLUMNS = (
    "exchange_seq", "exchange_ns", "id_high", "id_low", "other_high", "other_low", "side", "action", "reason",
    "order_type", "price_m", "price_s", "qty_m", "qty_s", "old_qty_m", "old_qty_s",
)


def _fields(payload: Column, kind: Column) -> Column:
    wanted = [(name, json_string, types) for name, types in _STRINGS.items()]
    wanted += [(name, json_raw, types) for name, types in _RAW.items()]
    return F.struct(*[F.when(kind.isin(*types), read(payload, name)).alias(name) for name, read, types in wanted])


def _zero_fixed() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(0).alias("s"))


def _zero_id() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))


def _optional(text: Column) -> Column:
    """Missing or blank reads as (0, 0); present but invalid stays NULL."""
    blank = text.isNull() | (F.btrim(text, F.lit(" \n\r\t")) == "")
    return F.when(blank, _zero_fixed()).otherwise(fixed_point(text))


def _by_type(kind: Column, **values: Column) -> Column:
    column = F.when(F.lit(False), next(iter(values.values())))
    for name, value in values.items():
        column = column.when(kind == name, value)
    return column


def _event(kind: Column, f: Column) -> Column:
    """The row of a frame as one struct, NULL when any needed field is missing or invalid."""
    zero, order_id = _zero_fixed(), uuid_halves(f["order_id"], allow_zero=False)
    done = F.when(f["reason"] == "filled", 4).when(
        f["reason"] == "canceled",
        F.when(F.coalesce(json_long_strict(f["cancel_reason"]) == 101, F.lit(False)), 6).otherwise(5),
    )
    placed = F.when(
        f["order_type"].isNotNull(),
        F.when(f["order_type"] == "limit", 1).when(f["order_type"] == "market", 2).when(f["order_type"] == "stop", 3).otherwise(0),
    )
    parts = F.struct(
        json_long_strict(f["sequence"]).alias("seq"),
        F.coalesce(rfc3339_nanos(f["time"]), F.lit(-1).cast("bigint")).alias("ns"),
        F.when(kind == "match", uuid_halves(f["maker_order_id"], allow_zero=False)).otherwise(order_id).alias("id"),
        F.when(kind == "match", uuid_halves(f["taker_order_id"], allow_zero=False)).otherwise(_zero_id()).alias("other"),
        F.when(f["side"] == "buy", 1).when(f["side"] == "sell", 2).alias("side"),
        _by_type(kind, received=F.lit(0), open=F.lit(1), done=done, activate=F.lit(2), change=F.lit(3), match=F.lit(0)).alias("reason"),
        _by_type(kind, received=placed, open=F.lit(1), done=F.lit(0), activate=F.lit(3), change=F.lit(0), match=F.lit(0)).alias("order_type"),
        F.when(kind.isin("received", "done"), _optional(f["price"]))
        .when(kind == "activate", fixed_point(f["stop_price"]))
        .otherwise(fixed_point(f["price"]))
        .alias("price"),
        _by_type(
            kind,
            received=_optional(f["size"]),
            open=fixed_point(f["remaining_size"]),
            done=fixed_point(f["remaining_size"]),
            activate=zero,
            change=fixed_point(f["new_size"]),
            match=fixed_point(f["size"]),
        ).alias("qty"),
        F.when(kind == "change", fixed_point(f["old_size"])).otherwise(zero).alias("old"),
    )

    def complete(p: Column) -> Column:
        present = F.lit(True)
        for name in ("seq", "id", "other", "side", "reason", "order_type", "price", "qty", "old"):
            present = present & p[name].isNotNull()
        row = F.struct(
            p["seq"].alias("exchange_seq"), p["ns"].alias("exchange_ns"),
            p["id"]["hi"].alias("id_high"), p["id"]["lo"].alias("id_low"),
            p["other"]["hi"].alias("other_high"), p["other"]["lo"].alias("other_low"),
            p["side"].alias("side"), F.lit(1).alias("action"), p["reason"].alias("reason"),
            p["order_type"].alias("order_type"),
            p["price"]["m"].alias("price_m"), p["price"]["s"].alias("price_s"),
            p["qty"]["m"].alias("qty_m"), p["qty"]["s"].alias("qty_s"),
            p["old"]["m"].alias("old_qty_m"), p["old"]["s"].alias("old_qty_s"),
        )
        return F.when(present, row)

    return let(parts, complete)


def classify_l3(frames: DataFrame) -> DataFrame:
    """Add ``frame_type, product_id, event, entry_count, over_cap, exchange_seq, exchange_ns, kind``."""
    payload, symbol, kind = F.col("payload"), F.col("symbol"), F.col("frame_type")
    data_types = (*ORDER_TYPES, "match")
    binary = F.col("payload_bin").isNotNull() if "payload_bin" in frames.columns else F.lit(False)
    typed = frames.select(
        "*", json_string(payload, "type").alias("frame_type"), json_string(payload, "product_id").alias("product_id")
    )
    ours = F.coalesce(F.col("product_id") == symbol, F.lit(False))
    parsed = typed.select(
        "*",
        let(
            F.when(ours & kind.isin(*data_types), kind),
            lambda t: F.when(t.isNotNull(), let(_fields(payload, t), lambda f: _event(t, f))),
        ).alias("event"),
    )
    head = F.struct(
        kind.alias("t"), F.col("product_id").alias("p"), F.col("event").isNotNull().alias("good"), binary.alias("binary")
    )

    def kind_of(h: Column) -> Column:
        t = h["t"]
        return (
            F.when(h["binary"], "unknown")
            .when(t.isNull(), "malformed")
            .when(t == "error", "error")
            .when(
                t == "subscriptions",
                F.when(ack_valid(payload, symbol, ACK_CHANNELS), F.lit("ack")).otherwise(F.lit("trigger")),
            )
            .when(~t.isin("heartbeat", *data_types), "unknown")
            .when(h["p"].isNull(), "malformed")
            .when(h["p"] != symbol, "mismatch")
            .when(t == "heartbeat", "heartbeat")
            .when(~h["good"], "bad_update")
            .when(t == "match", "trade")
            .otherwise("update")
        )

    return parsed.select(
        "*",
        F.when(F.col("event").isNotNull(), 1).otherwise(0).alias("entry_count"),
        F.lit(False).alias("over_cap"),
        F.col("event.exchange_seq").alias("exchange_seq"),
        F.col("event.exchange_ns").alias("exchange_ns"),
        let(head, kind_of).alias("kind"),
    )


def _with_event(classified: DataFrame, *keep: str) -> DataFrame:
    # A filter on the generator's output stays above it; one on the column would repeat the parse.
    return classified.select(*keep, F.explode_outer(F.array("event")).alias("event")).where("event is not null")


def order_events(classified: DataFrame, *keep: str, frame_type: str | None = None) -> DataFrame:
    """Order-lifecycle rows; the order time is the frame's time."""
    wanted = F.col("frame_type") == frame_type if frame_type else F.col("frame_type").isin(*ORDER_TYPES)
    rows = _with_event(classified.where(wanted), *keep)
    return rows.select(
        *keep,
        *[F.col(f"event.{c}").alias(c) for c in EVENT_COLUMNS if not c.startswith("other_")],
        F.col("event.exchange_ns").alias("order_ns"),
    )


def trades(classified: DataFrame, *keep: str) -> DataFrame:
    """Trade rows of match frames; ``taker_side`` is the side in the frame."""
    rows = _with_event(classified.where("frame_type = 'match'"), *keep)
    e = F.col("event")
    return rows.select(
        *keep,
        e["exchange_seq"].alias("exchange_seq"),
        e["exchange_ns"].alias("exchange_ns"),
        e["id_high"].alias("maker_high"),
        e["id_low"].alias("maker_low"),
        e["other_high"].alias("taker_high"),
        e["other_low"].alias("taker_low"),
        e["side"].alias("taker_side"),
        *[e[c].alias(c) for c in ("price_m", "price_s", "qty_m", "qty_s")],
    )


def rest_book_entries(documents: DataFrame, cap: int = MAX_ENTRIES) -> DataFrame:
    """Add ``sequence``, ``entries`` (texts) and ``refused`` to book documents with a ``payload``.

    Documents are read forwards: the sequence, then the bids behind it, then the asks behind those; a key
    that stands earlier is not seen. Entries are ``[price, size, order_id]``. A missing sequence, a bad
    order id or more than ``cap`` entries refuse the document (``refused`` tells which, first of these).
    """
    payload = F.col("payload")
    has_sequence = payload.rlike(r'"sequence"[ \n\r\t]*+:')
    number = r'"sequence"[ \n\r\t]*+:[ \n\r\t]*+([0-9]*+)(.*+)'
    staged = documents.select(
        "*",
        F.when(has_sequence, json_long_prefix(F.regexp_extract(payload, f"(?s){number}", 1))).alias("sequence"),
        F.regexp_extract(payload, f"(?s){number}", 2).alias("_behind"),
    )
    staged = staged.select("*", json_array(F.col("_behind"), "bids").alias("_bids"))
    after_key = F.regexp_extract("_behind", r'(?s)"bids"[ \n\r\t]*+:[ \n\r\t]*+(.*+)', 1)
    rest = F.when(F.col("_bids").isNull(), F.col("_behind")).otherwise(
        F.substring(after_key, F.length("_bids") + 1, F.length("_behind"))
    )
    staged = staged.select("*", json_array(rest, "asks").alias("_asks"))

    def side_entries(array: Column, side: int) -> Column:
        def build(price: Column, size: Column, order_id: Column) -> Column:
            return F.struct(
                F.lit(side).alias("side"), price.alias("price"), size.alias("size"), order_id.alias("order_id")
            )

        return F.when(array.isNull(), F.array()).otherwise(quoted_groups(array, 3, build))

    both = F.concat(side_entries(F.col("_bids"), 1), side_entries(F.col("_asks"), 2))
    found = staged.select("*", both.alias("_both")).drop("_behind", "_bids", "_asks")
    good_ids = F.coalesce(F.forall("_both", lambda e: is_uuid(e["order_id"])), F.lit(False))
    refused = (
        F.when(F.col("sequence").isNull(), "missing_sequence")
        .when(~good_ids, "bad_order_id")
        .when(F.size("_both") > cap, "over_cap")
    )
    told = found.select("*", refused.alias("refused"))
    return told.withColumn("entries", F.when(F.col("refused").isNull(), F.col("_both"))).drop("_both")


def refused_documents(documents: DataFrame, *keep: str, cap: int = MAX_ENTRIES) -> DataFrame:
    """A trigger row for every refused document: it asks for recovery."""
    parsed = rest_book_entries(documents, cap)
    # A filter on the column would be pushed down with a copy of the whole parse for every use of a value in it.
    told = parsed.select(*keep, F.explode_outer(F.array("refused")).alias("refused")).where("refused is not null")
    return told.select(*keep, F.lit("trigger").alias("kind"), "refused")


def flatten_rest_book(documents: DataFrame, *keep: str, cap: int = MAX_ENTRIES) -> DataFrame:
    """Order rows of accepted book documents: UPSERT, OPEN, LIMIT, no time, both sequences from the document.

    The document is accepted or refused on the texts; numbers are parsed after the explode. Price and size
    keep the reserved (maximum, 0) pair when they are invalid.
    """
    parsed = rest_book_entries(documents, cap)
    # The outer form keeps the optimizer from repeating the whole parse in an inferred filter.
    rows = parsed.select(*keep, "sequence", F.posexplode_outer("entries").alias("entry_pos", "e")).where(
        "entry_pos is not null and sequence is not null"
    )
    numbers = rows.select(
        *keep,
        "sequence",
        "entry_pos",
        "e.side",
        uuid_halves(F.col("e.order_id")).alias("id"),
        fixed_point(F.col("e.price")).alias("p"),
        fixed_point(F.col("e.size")).alias("q"),
    )
    reserved, zero = F.lit(MAX_MANTISSA), F.lit(0)
    return numbers.select(
        *keep,
        F.col("sequence").alias("seq1"),
        F.col("sequence").alias("seq2"),
        "entry_pos",
        F.col("id.hi").alias("id_high"),
        F.col("id.lo").alias("id_low"),
        "side",
        F.lit(1).alias("action"),
        F.lit(1).alias("reason"),
        F.lit(1).alias("order_type"),
        F.lit(-1).cast("bigint").alias("order_ns"),
        F.coalesce("p.m", reserved).alias("price_m"),
        F.coalesce("p.s", zero).alias("price_s"),
        F.coalesce("q.m", reserved).alias("qty_m"),
        F.coalesce("q.s", zero).alias("qty_s"),
    )
