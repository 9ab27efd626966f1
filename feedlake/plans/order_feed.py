"""Queries over the order-by-order feed (V3) and book documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import opposite_side
from feedlake.operators import counters
from feedlake.operators.l3 import classify_l3, flatten_rest_book, order_events, refused_documents, trades
from feedlake.operators.session_state import apply_session_rules
from feedlake.plans.oracle import fixed_m, fixed_s, raw_field, signed_half, text_field, times_ns, uuid_digits
from feedlake.plans.views import L3_FRAMES_SQL, duck_text, l3_frames, table
from feedlake.plans.registration import Family

FAMILY = Family()
register = FAMILY.register

_TEXT = ("type", "product_id", "time", "side", "order_id", "order_type", "reason", "maker_order_id", "taker_order_id")
_RAW = ("sequence", "price", "size", "remaining_size", "cancel_reason", "stop_price", "new_size", "old_size")


_PRICE = "case when type = 'activate' then stop_price else price end"
_QTY = """case type when 'received' then size when 'match' then size when 'change' then new_size
  when 'activate' then '0' else remaining_size end"""

L3_ROWS = f"""v as ({duck_text(L3_FRAMES_SQL)}),
f as (select instrument_id, arrival, symbol, payload,
  {", ".join(f"{text_field('payload', k)} as {k}" for k in _TEXT)},
  {", ".join(f"{raw_field('payload', k)} as {k}" for k in _RAW)} from v),
d as (select *, case when regexp_full_match(sequence, '[0-9]+') then try_cast(sequence as bigint) end as exchange_seq,
  {times_ns("time")} as exchange_ns,
  case side when 'buy' then 1 when 'sell' then 2 end as side_code,
  {uuid_digits("case when type = 'match' then maker_order_id else order_id end")} as id_hex,
  {uuid_digits("taker_order_id")} as other_hex,
  case type when 'received' then 0 when 'open' then 1 when 'activate' then 2 when 'change' then 3 when 'match' then 0
    when 'done' then case when reason = 'filled' then 4 when reason = 'canceled' then
      case when cancel_reason = '101' then 6 else 5 end end end as reason_code,
  case type when 'received' then case order_type when 'limit' then 1 when 'market' then 2 when 'stop' then 3 else 0 end
    when 'open' then 1 when 'activate' then 3 else 0 end as type_code,
  case when type in ('received', 'done') and price is null then 0 else {fixed_m(_PRICE)} end as price_m,
  case when type in ('received', 'done') and price is null then 0 else {fixed_s(_PRICE)} end as price_s,
  case when type = 'received' and size is null then 0 else {fixed_m(_QTY)} end as qty_m,
  case when (type = 'received' and size is null) then 0 else {fixed_s(_QTY)} end as qty_s,
  case when type = 'change' then {fixed_m("old_size")} else 0 end as old_qty_m,
  case when type = 'change' then {fixed_s("old_size")} else 0 end as old_qty_s from f),
k as (select *, case when type is null then 'malformed' when type = 'error' then 'error'
  when type = 'subscriptions' then case when payload like '%"name":"heartbeat"%' then 'ack' else 'trigger' end
  when type not in ('received','open','done','activate','change','match','heartbeat') then 'unknown'
  when product_id is null then 'malformed' when product_id <> symbol then 'mismatch'
  when type = 'heartbeat' then 'heartbeat'
  when exchange_seq is null or side_code is null or id_hex is null or id_hex = '{"0" * 32}' or reason_code is null
    or price_m is null or qty_m is null or old_qty_m is null then 'bad_update'
  when type = 'match' then 'trade' else 'update' end as kind from d)"""

_COLUMNS = f"""instrument_id, arrival, exchange_seq, exchange_ns, {signed_half("id_hex", 1)} as id_high, {signed_half("id_hex", 17)} as id_low,
  side_code as side, 1 as action, reason_code as reason, type_code as order_type,
  cast(price_m as bigint) as price_m, cast(price_s as integer) as price_s, cast(qty_m as bigint) as qty_m,
  cast(qty_s as integer) as qty_s, cast(old_qty_m as bigint) as old_qty_m, cast(old_qty_s as integer) as old_qty_s,
  exchange_ns as order_ns"""


def classified(spark, sf_dir):
    return classify_l3(l3_frames(spark, sf_dir))


@register(
    "p2_frame_kinds",
    f"with {L3_ROWS} select instrument_id, arrival, type as frame_type, product_id, kind from k",
)
def frame_kinds(spark, sf_dir):
    return classified(spark, sf_dir).select("instrument_id", "arrival", "frame_type", "product_id", "kind")


def _register_type(name: str, frame_type: str):
    @register(name, f"with {L3_ROWS} select {_COLUMNS} from k where kind = 'update' and type = '{frame_type}'")
    def rows(spark, sf_dir):
        return order_events(classified(spark, sf_dir), "instrument_id", "arrival", frame_type=frame_type)


for _name, _type in (
    ("p7_received", "received"),
    ("p8_open", "open"),
    ("p9_done", "done"),
    ("p10_activate", "activate"),
    ("p11_change", "change"),
):
    _register_type(_name, _type)


@register(
    "p12_matches",
    f"""with {L3_ROWS} select instrument_id, arrival, exchange_seq, exchange_ns,
  {signed_half("id_hex", 1)} as maker_high, {signed_half("id_hex", 17)} as maker_low,
  {signed_half("other_hex", 1)} as taker_high, {signed_half("other_hex", 17)} as taker_low,
  side_code as taker_side, cast(price_m as bigint) as price_m, cast(price_s as integer) as price_s,
  cast(qty_m as bigint) as qty_m, cast(qty_s as integer) as qty_s, 3 - side_code as maker_side from k where kind = 'trade'""",
)
def match_rows(spark, sf_dir):
    """F16 as well: the maker side is the opposite of the taker side."""
    rows = trades(classified(spark, sf_dir), "instrument_id", "arrival")
    return rows.withColumn("maker_side", opposite_side(F.col("taker_side")))


@register(
    "p16_error_frames",
    f"with {L3_ROWS} select instrument_id, count(*) as errors from k where kind = 'error' group by instrument_id",
)
def error_frames(spark, sf_dir):
    errors = classified(spark, sf_dir).where("frame_type = 'error'")
    return errors.groupBy("instrument_id").agg(F.count("*").alias("errors"))


@register(
    "p18_exchange_time",
    f"""with {L3_ROWS} select instrument_id, count(*) filter (where exchange_ns = -1) as without_time,
  max(exchange_ns) as newest_ns from k where kind in ('update', 'trade') group by instrument_id""",
)
def exchange_time(spark, sf_dir):
    good = classified(spark, sf_dir).where(F.col("event").isNotNull())
    return good.groupBy("instrument_id").agg(
        F.count_if(F.col("exchange_ns") == -1).alias("without_time"), F.max("exchange_ns").alias("newest_ns")
    )


@register(
    "a1_order_feed_accounting",
    f"""with {L3_ROWS},
b as (select *, case when kind = 'heartbeat' and arrival % 3 = 0 then 'snapshot' else kind end as kind2 from k),
g as (select *, sum(case when kind2 in ('trigger','error') then 1 else 0 end) over (partition by instrument_id order by arrival rows unbounded preceding) as seg from b),
h as (select *, sum(case when kind2 = 'snapshot' then 1 else 0 end) over (partition by instrument_id, seg order by arrival rows unbounded preceding) % 2 as open_after from g),
i as (select *, coalesce(lag(open_after) over (partition by instrument_id order by arrival), 0) as open_before from h)
select instrument_id, count(*) as frames_received, cast(sum(strlen(payload)) as bigint) as bytes_received,
  count(*) filter (where kind2 in ('heartbeat','ack','error') or (kind2 in ('snapshot') and open_before = 0) or (kind2 in ('update','trade') and open_before = 1)) as messages_decoded,
  count(*) filter (where kind2 = 'snapshot' and open_before = 0) as snapshot_messages_received,
  count(*) filter (where kind2 in ('update','trade') and open_before = 1) as update_messages_received,
  count(*) filter (where kind2 = 'heartbeat') as heartbeats_received,
  count(*) filter (where kind2 = 'malformed' or (kind2 = 'bad_update' and open_before = 1)) as parse_failures,
  count(*) filter (where kind2 = 'malformed' or (kind2 = 'bad_update' and open_before = 1)) as malformed_rejections,
  count(*) filter (where kind2 = 'error') as authentication_errors,
  count(*) filter (where kind2 = 'unknown') as unknown_type_drops,
  count(*) filter (where kind2 in ('update','trade','bad_update') and open_before = 0) as pre_snapshot_drops,
  count(*) filter (where kind2 = 'mismatch') as unknown_symbol_drops,
  count(*) filter (where kind2 = 'mismatch') as product_id_mismatches,
  count(*) filter (where kind2 = 'trigger') as subscription_validation_failures
from i group by instrument_id""",
)
def order_feed_accounting(spark, sf_dir):
    """Session rules of the order feed: every third heartbeat position stands in for an accepted book document."""
    frames = l3_frames(spark, sf_dir).withColumn("frame_bytes", F.octet_length("payload"))
    stand_in = (F.col("kind") == "heartbeat") & (F.col("arrival") % 3 == 0)
    rows = (
        classify_l3(frames)
        .select("instrument_id", "arrival", "kind", "over_cap", "frame_bytes")
        .withColumn("kind", F.when(stand_in, F.lit("snapshot")).otherwise(F.col("kind")))
    )
    return counters.aggregate(apply_session_rules(rows), counters.frame_accounting(), "instrument_id")


# Book documents from orders: 1 to 4 bids and as many asks per row, every 23rd with a bad order id.
_ID = "md5(concat(cast(o_orderkey as TXT), '-', cast(o_custkey as TXT), '-', cast({i} as TXT)))"
_COUNT = "1 + o_orderkey % 4"


def _side(i: str, shift: int) -> str:
    return (
        f"""concat('["', cast(cast(o_totalprice as decimal(18,2)) as TXT), cast({i} as TXT), '","', cast({i} + {shift} as TXT), '.25","', """
        f"""case when o_orderkey % 23 = 0 and {i} = 2 then 'broken' else {_ID.format(i=f"({i} + {shift})")} end, '"]')"""
    )


def _spark_array(shift: int) -> str:
    return f"""array_join(transform(sequence(1, {_COUNT}), i -> {_side("i", shift)}), ', ')"""


# Every key order, and documents without a sequence.
_SPARK_DOCUMENT = f"""case cast(o_orderkey % 6 as int)
  when 0 then concat('{{"bids": [', {_spark_array(0)}, '], "sequence": ', cast(o_orderkey as TXT), ', "asks":[', {_spark_array(100)}, ']}}')
  when 1 then concat('{{"sequence": ', cast(o_orderkey as TXT), ', "asks":[', {_spark_array(100)}, '],"bids":[', {_spark_array(0)}, ']}}')
  when 2 then concat('{{"asks":[', {_spark_array(100)}, '],"sequence":', cast(o_orderkey as TXT), ',"bids" : [', {_spark_array(0)}, ']}}')
  when 3 then concat('{{"bids":[', {_spark_array(0)}, '],"asks":[', {_spark_array(100)}, ']}}')
  else concat('{{"sequence" : ', cast(o_orderkey as TXT), ',"bids":[', {_spark_array(0)}, '], "asks": [', {_spark_array(100)}, ']}}') end""".replace(
    "TXT", "string"
)
# Remainders by 6 of the documents whose bids (side 1) and asks (side 2) stand where they are read.
_READ = {1: "(1, 2, 4, 5)", 2: "(0, 4, 5)"}
# The broken id is seen only on a side that is read.
_BROKEN = f"(o_orderkey % 23 = 0 and {_COUNT} >= 2 and o_orderkey % 6 <> 3)"


def rest_documents(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("instrument_id"), "o_orderkey", F.expr(_SPARK_DOCUMENT).alias("payload")
    )


def _expected_side(side: int, shift: int) -> str:
    hex_id = _ID.format(i=f"(i + {shift})").replace("TXT", "varchar")
    first = f"case when o_orderkey % 6 in {_READ[1]} then {_COUNT} else 0 end" if side == 2 else "0"
    return f"""select cast(o_custkey % 50 as bigint) as instrument_id, cast(o_orderkey as bigint) as seq1, cast(o_orderkey as bigint) as seq2,
  cast(i - 1 + {first} as integer) as entry_pos,
  {signed_half(hex_id, 1)} as id_high, {signed_half(hex_id, 17)} as id_low, {side} as side, 1 as action, 1 as reason, 1 as order_type,
  cast(-1 as bigint) as order_ns, cast(cast(o_totalprice as decimal(18,2)) * 1000 + i as bigint) as price_m, 3 as price_s,
  cast((i + {shift}) * 100 + 25 as bigint) as qty_m, 2 as qty_s from n where o_orderkey % 6 in {_READ[side]}"""


@register(
    "p13_s2_rest_books",
    f"""with n as (select o.*, i from orders o, range(1, 5) r(i) where i <= {_COUNT} and not {_BROKEN})
{_expected_side(1, 0)} union all {_expected_side(2, 100)}""",
)
def rest_books(spark, sf_dir):
    return flatten_rest_book(rest_documents(spark, sf_dir), "instrument_id")


@register(
    "p13_refused_documents",
    f"""select cast(o_orderkey as bigint) as o_orderkey, 'trigger' as kind, case when o_orderkey % 6 = 3 then 'missing_sequence'
  when {_BROKEN} then 'bad_order_id' else 'over_cap' end as refused from orders
where o_orderkey % 6 = 3 or {_BROKEN} or (o_orderkey % 6 in (4, 5) and 2 * ({_COUNT}) > 7)""",
)
def refused_books(spark, sf_dir):
    """Documents that ask for recovery, with the entry cap lowered to 7."""
    return refused_documents(rest_documents(spark, sf_dir), "o_orderkey", cap=7)
