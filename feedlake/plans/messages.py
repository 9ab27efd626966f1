"""Queries over binary messages: encode, decode, traces and recovery control messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import ntz_nanos
from feedlake.operators.l2 import classify_l2
from feedlake.operators.l3 import classify_l3, order_events, trades
from feedlake.operators.recovery import batch_result, route_requests
from feedlake.operators.session_state import apply_session_rules, emit_resets
from feedlake.operators.wire import (
    decode_entries,
    decode_messages,
    decode_requests,
    encode_messages,
    encode_request,
    encode_request_batch,
)
from feedlake.plans.oracle import L2_RULES, signed_half
from feedlake.plans.order_feed import L3_ROWS
from feedlake.plans.registration import Family
from feedlake.plans.views import REQUESTS_SQL, connectors, l2_frames, l3_frames, recovery_requests
from feedlake.session import fresh_path
from feedlake.sources.trace import parse_trace_line, read_trace, trace_line, write_trace

FAMILY = Family()
register = FAMILY.register


def _level_rules(spark, sf_dir):
    return apply_session_rules(
        classify_l2(l2_frames(spark, sf_dir)).select(
            "instrument_id", "arrival", "kind", "levels", "exchange_ns", ntz_nanos(F.col("ts")).alias("ingress_ns")
        )
    )


def level_messages(spark, sf_dir):
    """Published snapshots and updates of V1 as encoded messages."""
    rows = _level_rules(spark, sf_dir).where("publishable")
    event = F.when(F.col("disposition") == "accepted_snapshot", 2).otherwise(3)
    seq = F.col("gateway_seq")
    body = rows.withColumns(
        {"event_type": event, "venue": F.lit(1), "book_depth": F.lit(2), "seq1": seq, "seq2": seq, "entries": F.col("levels")}
    )
    return encode_messages(body, 1, "instrument_id", "arrival")


def _le(value: str, size: int) -> str:
    digits = f"lpad(hex(cast({value} as bigint)), 16, '0')"
    return "concat(" + ", ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(size)) + ")"


_CENTS = "cast(cast({} as decimal(18,2)) * 100 as bigint)"
_LEVEL = "concat({side}, {action}, '02', {qs}, {price}, {qty})"
_FLAT = f"""{L2_RULES}, m as (select r.*, e.event_type as et, e.value from r join events e using (event_id)),
x as (select instrument_id, arrival, concat('0BEB02013300', case when acc_pos is not null then '0200' else '0100' end,
  case when acc_pos is not null then '02' else '03' end, '0102', {_le("instrument_id", 4)}, {_le("gateway_seq", 8)}, {_le("gateway_seq", 8)}, {_le("gateway_seq", 8)},
  'FFFFFFFFFFFFFFFF', {_le("epoch_us(ts) * 1000", 8)}, '00000000',
  case when acc_pos is not null then concat(
    '01010202', {_le(_CENTS.format("value"), 8)}, {_le("150", 8)}, '02010202', {_le(_CENTS.format("value + 1"), 8)}, {_le("200", 8)})
  else concat(case when et = 'click' then '01' else '02' end, case when et = 'click' and event_id % 5 = 0 then '0202' else '0102' end,
    case when et = 'click' and event_id % 5 = 0 then '00' else '02' end, {_le(_CENTS.format("value"), 8)},
    {_le("case when et <> 'click' then 100 when event_id % 5 = 0 then 0 else 325 end", 8)}) end) as message_hex from m where pub = 1)"""


@register("c1_encode_levels", f"with {_FLAT} select instrument_id, arrival, message_hex from x")
def c1_encode_levels(spark, sf_dir):
    return level_messages(spark, sf_dir).select("instrument_id", "arrival", F.hex("message").alias("message_hex"))


@register(
    "c2_decode_levels",
    f"""with {_FLAT}, lv as (select instrument_id, arrival, gateway_seq, case when acc_pos is not null then 2 else 3 end as event_type, epoch_us(ts) * 1000 as ingress,
  et, event_id, value, acc_pos, 0 as entry_pos from m where pub = 1 union all
  select instrument_id, arrival, gateway_seq, 2, epoch_us(ts) * 1000, et, event_id, value, acc_pos, 1 from m where acc_pos is not null)
select instrument_id, arrival, event_type as msg_event_type, 1 as msg_venue, 2 as msg_book_depth, instrument_id as msg_instrument_id,
  gateway_seq as msg_gateway_seq, gateway_seq as msg_seq1, gateway_seq as msg_seq2, cast(-1 as bigint) as msg_exchange_ns, ingress as msg_ingress_ns, entry_pos,
  case when acc_pos is not null then entry_pos + 1 when et = 'click' then 1 else 2 end as side,
  case when acc_pos is null and et = 'click' and event_id % 5 = 0 then 2 else 1 end as action, 2 as price_s,
  case when acc_pos is null and et = 'click' and event_id % 5 = 0 then 0 else 2 end as qty_s,
  {_CENTS.format("value + entry_pos")} as price_m,
  cast(case when acc_pos is not null then 150 + 50 * entry_pos when et <> 'click' then 100 when event_id % 5 = 0 then 0 else 325 end as bigint) as qty_m from lv""",
)
def c2_decode_levels(spark, sf_dir):
    return decode_entries(level_messages(spark, sf_dir), 1, "instrument_id", "arrival")


def _order_body(rows, event: int):
    return rows.withColumns(
        {
            "event_type": F.lit(event), "venue": F.lit(2), "book_depth": F.lit(3), "gateway_seq": F.col("arrival"),
            "seq1": F.col("exchange_seq"), "seq2": F.col("exchange_seq"), "ingress_ns": F.col("arrival"),
        }
    )


_ENTRY_SQL = "cast(price_m as bigint) as price_m, cast(price_s as integer) as price_s, cast(qty_m as bigint) as qty_m, cast(qty_s as integer) as qty_s"


@register(
    "c2_decode_orders",
    f"""with {L3_ROWS} select instrument_id, arrival, exchange_seq as msg_seq1, exchange_ns as msg_exchange_ns, 0 as entry_pos,
  {signed_half("id_hex", 1)} as id_high, {signed_half("id_hex", 17)} as id_low, side_code as side, 1 as action, reason_code as reason,
  type_code as order_type, exchange_ns as order_ns, {_ENTRY_SQL},
  cast(old_qty_m as bigint) as old_qty_m, cast(old_qty_s as integer) as old_qty_s from k where kind = 'update'""",
)
def c2_decode_orders(spark, sf_dir):
    rows = _order_body(order_events(classify_l3(l3_frames(spark, sf_dir)), "instrument_id", "arrival"), 3)
    names = ("id_high", "id_low", "side", "action", "reason", "order_type", "price_s", "qty_s", "old_qty_s", "order_ns", "price_m", "qty_m", "old_qty_m")
    encoded = encode_messages(rows.withColumn("entries", F.array(F.struct(*names))), 2, "instrument_id", "arrival")
    return decode_entries(encoded, 2, "instrument_id", "arrival").select(
        "instrument_id", "arrival", "msg_seq1", "msg_exchange_ns", "entry_pos", *names
    )


@register(
    "c2_decode_trades",
    f"""with {L3_ROWS} select instrument_id, arrival, 4 as msg_event_type, exchange_seq as msg_seq2, {signed_half("id_hex", 1)} as maker_high,
  {signed_half("id_hex", 17)} as maker_low, {signed_half("other_hex", 1)} as taker_high, {signed_half("other_hex", 17)} as taker_low,
  side_code as taker_side, {_ENTRY_SQL} from k where kind = 'trade'""",
)
def c2_decode_trades(spark, sf_dir):
    rows = _order_body(trades(classify_l3(l3_frames(spark, sf_dir)), "instrument_id", "arrival"), 4)
    names = ("maker_high", "maker_low", "taker_high", "taker_low", "taker_side", "price_s", "qty_s", "price_m", "qty_m")
    encoded = encode_messages(rows.withColumn("entries", F.array(F.struct(*names))), 3, "instrument_id", "arrival")
    return decode_entries(encoded, 3, "instrument_id", "arrival").select(
        "instrument_id", "arrival", "msg_event_type", "msg_seq2", *names
    )


def reset_messages(spark, sf_dir):
    rows = emit_resets(_level_rules(spark, sf_dir), "instrument_id", "arrival", "ingress_ns")
    names = ("side", "action", "price_s", "qty_s", "price_m", "qty_m")
    empty = F.slice(F.array(F.struct(*[F.lit(0).alias(n) for n in names])), 1, 0)
    body = rows.withColumns({"venue": F.lit(1), "book_depth": F.lit(2), "entries": empty})
    return encode_messages(body, 1, "instrument_id", "arrival")


@register(
    "c5_reset_messages",
    f"""with {L2_RULES} select instrument_id, arrival, concat('0BEB0201330000000101', '02', {_le("instrument_id", 4)}, repeat('0', 48),
  'FFFFFFFFFFFFFFFF', {_le("epoch_us(ts) * 1000", 8)}, '00000000') as message_hex from r where attempt = 1""",
)
def c5_reset_messages(spark, sf_dir):
    return reset_messages(spark, sf_dir).select("instrument_id", "arrival", F.hex("message").alias("message_hex"))


@register(
    "s3_s4_trace_round_trip",
    f"""with {L2_RULES} select instrument_id, event_type, gateway_seq, exchange_ns, ingress_ns, entry_count, true as valid from (
  select instrument_id, case when acc_pos is not null then 2 else 3 end as event_type, gateway_seq, cast(-1 as bigint) as exchange_ns, epoch_us(ts) * 1000 as ingress_ns,
    case when acc_pos is not null then 2 else 1 end as entry_count from r where pub = 1
  union all select instrument_id, 1, 0, -1, epoch_us(ts) * 1000, 0 from r where attempt = 1) x""",
)
def s3_s4_trace(spark, sf_dir):
    """Messages and resets written as a gzip text trace in the shared folder, read back and decoded."""
    both = level_messages(spark, sf_dir).unionByName(reset_messages(spark, sf_dir))
    path = fresh_path(spark, "trace")
    write_trace(both, path)
    return decode_messages(read_trace(spark, path)).select(
        "instrument_id", "event_type", "gateway_seq", "exchange_ns", "ingress_ns", "entry_count", "valid"
    )


@register(
    "f14_base64",
    f"with {_FLAT} select instrument_id, arrival, concat('sbe_base64=', replace(base64(from_hex(message_hex)), chr(10), '')) as line, true as same from x",
)
def f14_base64(spark, sf_dir):
    lines = level_messages(spark, sf_dir).withColumn("line", F.regexp_replace(trace_line(F.col("message")), r"\s", ""))
    same = parse_trace_line(F.concat(F.lit("INFO "), "line")) == F.col("message")
    return lines.select("instrument_id", "arrival", "line", same.alias("same"))


def _request_messages(spark, sf_dir):
    """V4 as control messages; every eleventh is cut short by one byte."""
    code = encode_request(
        F.col("venue"), F.col("instrument_id"), F.col("request_type"), F.col("reason_code"),
        F.col("request_id") * 1_000, F.concat(F.lit("réq "), F.col("request_id").cast("string")),
    )
    rows = recovery_requests(spark, sf_dir).withColumn("message", code)
    cut = F.expr("substring(message, 1, octet_length(message) - 1)")
    return rows.select(
        "request_id", F.when(F.col("request_id") % 11 == 0, cut).otherwise(F.col("message")).alias("message")
    )


@register(
    "c3_c4_requests",
    f"""with q as ({REQUESTS_SQL}) select request_id, request_id % 11 = 0 as malformed,
  case when request_id % 11 <> 0 then venue end as venue, case when request_id % 11 <> 0 then request_type end as request_type,
  case when request_id % 11 <> 0 then reason_code end as reason_code, case when request_id % 11 <> 0 then request_id * 1000 end as at_ns,
  case when request_id % 11 <> 0 then concat('réq ', cast(request_id as varchar)) end as text,
  case when request_id % 11 <> 0 then instrument_id end as instrument_id from q""",
)
def c3_c4_requests(spark, sf_dir):
    return decode_requests(_request_messages(spark, sf_dir), "request_id")


@register(
    "c3_c4_request_batches",
    f"""with q as ({REQUESTS_SQL}) select venue, request_type, reason_code, request_id // 1000 as batch, false as malformed,
  cast(77 as bigint) as at_ns, instrument_id, count(*) as requests from q group by venue, request_type, reason_code, request_id // 1000, instrument_id""",
)
def c3_c4_request_batches(spark, sf_dir):
    """Batches of requests with the same venue, type and reason; request ids bound each to 1000 members."""
    batch = F.expr("request_id div 1000").alias("batch")
    groups = (
        recovery_requests(spark, sf_dir)
        .groupBy("venue", "request_type", "reason_code", batch)
        .agg(F.collect_list("instrument_id").alias("ids"))
    )
    message = encode_request_batch(F.col("venue"), F.col("ids"), F.col("request_type"), F.col("reason_code"), F.lit(77))
    decoded = decode_requests(groups.select("batch", message.alias("message")), "batch")
    return decoded.groupBy(
        "venue", "request_type", "reason_code", "batch", "malformed", "at_ns", "instrument_id"
    ).agg(F.count("*").alias("requests"))


@register(
    "a8_received_requests",
    f"""with q as ({REQUESTS_SQL}), c as (select distinct user_id as instrument_id from events),
o as (select case when request_id % 11 = 0 then 'malformed' when q.venue = 1 and c.instrument_id is not null then 'accepted'
  when q.venue = 1 then 'unknown' else 'rejected' end as outcome, request_id % 10 as batch from q left join c using (instrument_id))
select batch, count(*) filter (where outcome <> 'malformed') as decoded, count(*) filter (where outcome = 'accepted') as accepted,
  count(*) filter (where outcome = 'rejected') as rejected, count(*) filter (where outcome = 'unknown') as unknown_instrument,
  count(*) filter (where outcome = 'malformed') as malformed from o group by batch""",
)
def a8_received_requests(spark, sf_dir):
    """From bytes to the result of each batch: decode, route, count."""
    decoded = decode_requests(_request_messages(spark, sf_dir), "request_id")
    routed = route_requests(decoded, connectors(spark, sf_dir), own_venue=1)
    outcome = F.when(F.col("malformed"), F.lit("malformed")).otherwise(F.col("outcome"))
    rows = routed.select((F.col("request_id") % 10).alias("batch"), outcome.alias("outcome"))
    return batch_result(rows, "batch")
