"""Queries over level frames of every shape (V8): many changes, mixed scales, refused and unknown frames, failed recoveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import counters
from feedlake.operators.l2 import classify_l2, flatten_levels
from feedlake.operators.ordering import dense_arrival
from feedlake.operators.session_state import apply_session_rules
from feedlake.plans.oracle import L2_KINDS, L2_RULES, PRIOR
from feedlake.plans.registration import Family
from feedlake.plans.views import duck_text, spark_text, table
from feedlake.session import stored

FAMILY = Family()
register = FAMILY.register

CAP = 5
# Lines of an order by number; numbers may repeat.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LN = f"cast(row_number() over (partition by l_orderkey order by {', '.join(_LINE_ORDER)}) as bigint)"
# One frame per order, one level per line. Which kind of frame an order makes, and what is wrong with it.
_TYPE = "case when o_orderkey % 9 < 2 then 'snapshot' when o_orderkey % 9 = 2 then 'heartbeat' when o_orderkey % 9 = 3 then 'subscriptions' else 'l2update' end"
_FAULT = """case when o_orderkey % 23 = 5 then 'no_type' when o_orderkey % 29 = 7 then 'other_type' when o_orderkey % 31 = 3 then 'other_product'
    when o_orderkey % 13 = 8 then 'bad_side' when o_orderkey % 17 = 4 then 'negative' when o_orderkey % 19 = 6 then 'bad_price' end"""
# Price and size of a line as written: scales of 0 to 3, a sign, no leading digit, a trailing point.
_PRICE = """case ln % 4 when 0 then cast(cast(floor(l_extendedprice) as bigint) as TXT) when 1 then cast(cast(l_extendedprice as decimal(18,2)) as TXT)
    when 2 then concat(cast(cast(floor(l_extendedprice) as bigint) as TXT), '.') else concat(cast(cast(floor(l_extendedprice) as bigint) as TXT), '.125') end"""
_SIZE = """case when l_returnflag = 'R' then case when ln % 2 = 0 then '0' else '0.000' end
    when ln % 3 = 0 then concat('.', cast(cast(floor(l_quantity) as bigint) + 10 as TXT)) else concat(cast(cast(floor(l_quantity) as bigint) as TXT), '.5') end"""
_LAST = "ln = lines"
_WRITTEN = f"""case when fault = 'bad_price' and {_LAST} then '1e5' else {_PRICE} end as price,
  case when fault = 'negative' and {_LAST} then '-1.5' else {_SIZE} end as size,
  case when fault = 'bad_side' and {_LAST} then 'hold' when ln % 2 = 1 then 'buy' else 'sell' end as side"""
_PAIR = """concat('["', price, '", "', size, '"]')"""
_TRIPLE = """concat('["', side, '","', price, '","', size, '"]')"""
# Around the levels: ``bids``, ``asks`` and ``changes`` are the texts of the arrays.
_FRAME = """concat('{', case when fault = 'no_type' then '"kind":' else '"type" : ' end, '"', case when fault = 'other_type' then 'status' else type end, '",',
  '"product_id":"H', cast(instrument_id + case when fault = 'other_product' then 1 else 0 end as TXT), '"', case type
    when 'snapshot' then concat(',"bids":[', bids, '],"asks":[', asks, ']')
    when 'l2update' then concat(',"changes":[', changes, '],"time":"2024-01-0', cast(1 + o_orderkey % 9 as TXT), 'T00:00:01.5Z"')
    when 'subscriptions' then concat(',"channels":[{"name":"level2","product_ids":["H', cast(instrument_id as TXT), '"]}', case when o_orderkey % 2 = 0 then ''
      else concat(',{"name":"heartbeat","product_ids":["H', cast(instrument_id as TXT), '"]}') end, ']') else '' end, '}')"""
_FAILED = "o_orderkey % 37 = 11"

_FRAMES_SQL = duck_text(f"""lines as (select l_orderkey, count(*) as lines from lineitem group by l_orderkey),
orders_ as (select o_orderkey, cast(o_custkey % 40 as bigint) as instrument_id, {_TYPE} as type, {_FAULT} as fault, lines,
  cast(row_number() over (partition by o_custkey % 40 order by o_orderdate, o_orderkey) as bigint) as arrival
  from orders join lines on l_orderkey = o_orderkey),
levels_ as (select o.*, ln, {_WRITTEN} from orders_ o join (select *, {_LN} as ln from lineitem) on l_orderkey = o_orderkey),
texts as (select o_orderkey, coalesce(string_agg({_PAIR}, ',' order by ln) filter (where ln % 2 = 1), '') as bids,
  coalesce(string_agg({_PAIR}, ' , ' order by ln) filter (where ln % 2 = 0), '') as asks,
  string_agg({_TRIPLE}, ',' order by ln) as changes from levels_ group by o_orderkey),
v as (select o.*, {_FRAME} as payload from orders_ o join texts using (o_orderkey))""")

# What the frame is, from how it was made.
_KINDS = f"""{_FRAMES_SQL},
k as (select *, o_orderkey as event_id, case when {_FAILED} then 'recovery_failed' when fault = 'no_type' then 'malformed'
    when fault = 'other_type' then 'unknown'
    when type = 'subscriptions' then case when o_orderkey % 2 = 0 then 'trigger' else 'ack' end
    when fault = 'other_product' then 'mismatch' when type = 'heartbeat' then 'heartbeat'
    when type = 'snapshot' then case when fault = 'bad_price' or lines > {CAP} then 'bad_snapshot' else 'snapshot' end
    when fault in ('bad_price', 'negative', 'bad_side') or lines > {CAP} then 'bad_update' else 'update' end as kind,
  lines > {CAP} and case when type = 'snapshot' then fault is distinct from 'bad_price'
    else fault is null or fault not in ('bad_price', 'negative', 'bad_side') end as over_cap from v)"""
_PF = f"coalesce(max(case when kind = 'recovery_failed' then arrival end) over (partition by instrument_id {PRIOR}), 0)"
_RULES = _KINDS + L2_RULES[len(L2_KINDS) :].replace("as pt from j", f"as pt, {_PF} as pf from j").replace(
    "and pt <= pa then", "and (pt <= pa or pt <= pf) then"
).replace("and pt > pa then", "and pt > pa and pt > pf then")


def hard_frames(spark, sf_dir):
    """V8 as frames; a failed recovery is a row without a payload."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    counted = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    heads = orders.join(counted, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_orderkey", "o_orderdate", "cast(o_custkey % 40 as bigint) as instrument_id", f"{_TYPE} as type", f"{_FAULT} as fault", "lines"
    )
    # Numbered while they are narrow: the ranges are sampled first, which would make every text twice.
    heads = dense_arrival(heads, ["instrument_id"], ["o_orderdate", "o_orderkey"])
    written = [e.strip() for e in spark_text(_WRITTEN).replace(" as price,", " as price;").replace(" as size,", " as size;").split(";")]
    lines = lineitem.selectExpr("*", f"{_LN} as ln")
    levels = heads.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_orderkey", "ln", *written)
    told = levels.selectExpr("o_orderkey", f"struct(ln as n, {_PAIR} as pair, {_TRIPLE} as triple) as line")
    listed = told.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("all"))
    texts = listed.selectExpr(
        "o_orderkey", "array_join(transform(filter(all, x -> x.n % 2 = 1), x -> x.pair), ',') as bids",
        "array_join(transform(filter(all, x -> x.n % 2 = 0), x -> x.pair), ' , ') as asks",
        "array_join(transform(all, x -> x.triple), ',') as changes",
    )
    frames = heads.join(texts, "o_orderkey").selectExpr(
        "instrument_id", "o_orderkey", "arrival", "concat('H', cast(instrument_id as string)) as symbol", f"{_FAILED} as failed",
        f"{spark_text(_FRAME)} as payload",
    )
    return stored(frames, "hard-frames")


def _classified(spark, sf_dir):
    told = classify_l2(hard_frames(spark, sf_dir).withColumn("frame_bytes", F.octet_length("payload")), max_entries=CAP)
    return told.withColumn("kind", F.when(F.col("failed"), "recovery_failed").otherwise(F.col("kind")))


def _ruled(spark, sf_dir):
    rows = _classified(spark, sf_dir).select("instrument_id", "arrival", "kind", "over_cap", "entry_count", "frame_bytes")
    return apply_session_rules(rows, failures=True)


@register(
    "p1_hard_frames",
    f"with {_KINDS} select instrument_id, arrival, kind, over_cap and kind in ('bad_snapshot', 'bad_update') as over_cap from k",
)
def hard_kinds(spark, sf_dir):
    """P1, P4, P15, P17: malformed, unknown, foreign, refused and oversized frames."""
    over = F.coalesce(F.col("over_cap"), F.lit(False)) & F.col("kind").isin("bad_snapshot", "bad_update")
    return _classified(spark, sf_dir).select("instrument_id", "arrival", "kind", over.alias("over_cap"))


def _fixed_sql(text: str) -> str:
    return f"cast(replace(replace({text}, '.', ''), '-', '') as bigint) * case when {text} like '-%' then -1 else 1 end"


def _scale_sql(text: str) -> str:
    return f"cast(case when {text} like '%.%' then length({text}) - instr({text}, '.') else 0 end as integer)"


@register(
    "p5_p6_hard_levels",
    f"""with {_KINDS}, e as (select l.*, k.kind, case when k.kind = 'update' then l.ln - 1
    else row_number() over (partition by k.o_orderkey order by l.ln % 2 desc, l.ln) - 1 end as entry_pos
  from levels_ l join k using (o_orderkey) where k.kind in ('snapshot', 'update'))
select instrument_id, arrival, cast(entry_pos as integer) as entry_pos, case when ln % 2 = 1 then 1 else 2 end as side,
  case when kind = 'update' and {_fixed_sql('size')} = 0 then 2 else 1 end as action,
  {_fixed_sql('price')} as price_m, {_scale_sql('price')} as price_s, {_fixed_sql('size')} as qty_m, {_scale_sql('size')} as qty_s from e""",
)
def hard_levels(spark, sf_dir):
    """P5, P6: up to five levels per frame at the scales in which they are written; a snapshot may have negative sizes."""
    # As a value, since a filter on the kind would repeat the parse below it.
    levels = F.when(F.col("kind").isin("snapshot", "update"), F.col("levels"))
    return flatten_levels(_classified(spark, sf_dir).withColumn("levels", levels), "instrument_id", "arrival")


@register(
    "a1_hard_accounting",
    f"""with {_RULES} select instrument_id, count(*) as frames_received, cast(sum(strlen(payload)) as bigint) as bytes_received,
  count(*) filter (where disposition in ('accepted_snapshot', 'published', 'heartbeat', 'ack')) as messages_decoded,
  count(*) filter (where disposition = 'accepted_snapshot') as snapshot_messages_received,
  count(*) filter (where disposition = 'published') as update_messages_received,
  count(*) filter (where disposition = 'heartbeat') as heartbeats_received,
  count(*) filter (where disposition = 'malformed' or (disposition = 'rejected' and not over_cap)) as parse_failures,
  count(*) filter (where disposition = 'malformed' or (disposition = 'rejected' and not over_cap)) as malformed_rejections,
  count(*) filter (where disposition = 'error') as authentication_errors,
  count(*) filter (where disposition = 'unknown') as unknown_type_drops,
  count(*) filter (where disposition = 'pre_snapshot') as pre_snapshot_drops,
  count(*) filter (where disposition = 'mismatch') as unknown_symbol_drops,
  count(*) filter (where disposition = 'mismatch') as product_id_mismatches,
  count(*) filter (where disposition = 'trigger') as subscription_validation_failures from r group by instrument_id""",
)
def hard_frame_accounting(spark, sf_dir):
    return counters.aggregate(_ruled(spark, sf_dir), counters.frame_accounting(), "instrument_id")


@register(
    "a2_hard_accounting",
    f"""with {_RULES} select instrument_id, cast(sum(pub) as bigint) as encode_successes,
  count(*) filter (where disposition = 'rejected' and over_cap) as encode_failures,
  cast(coalesce(sum(case when pub = 1 then lines end), 0) as bigint) as levels_encoded,
  cast(coalesce(sum(case when pub = 1 then 59 + 20 * lines end), 0) as bigint) as encoded_bytes from r group by instrument_id""",
)
def hard_encode_accounting(spark, sf_dir):
    return counters.aggregate(_ruled(spark, sf_dir), counters.encode_accounting(F.lit(1)), "instrument_id")


@register(
    "a3_hard_accounting",
    f"""with {_RULES} select instrument_id, cast(sum(attempt) as bigint) as recovery_attempts, cast(sum(attempt) as bigint) as recovery_executions,
  count(*) filter (where acc_pos is not null and pt > pa and pt > pf) as recovery_completions,
  count(*) filter (where kind = 'recovery_failed') as recovery_failures, cast(sum(ignored) as bigint) as recovery_requests_ignored_in_progress
from r group by instrument_id""",
)
def hard_recovery_accounting(spark, sf_dir):
    """A recovery that is recorded as failed does not complete, and the next trigger starts another one."""
    return counters.aggregate(_ruled(spark, sf_dir), counters.recovery_accounting(), "instrument_id")
