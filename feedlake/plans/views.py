"""Feed-shaped views over the benchmark tables.

The row expressions below only *derive input data*; both the DataFrame plans and the SQL oracles
start from the same derivation and then compute independently. ``TXT`` is the engine's text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import ntz_nanos
from feedlake.operators.ordering import Lane, dense_arrival, running, sum_upto

L2_PAYLOAD = """case event_type
    when 'signup' then concat('{"type":"snapshot","product_id":"P', cast(user_id as TXT), '","bids":[["', cast(cast(value as decimal(18,2)) as TXT), '","', case when event_id % 19 = 0 then 'bad' else '1.50' end, '"]],"asks":[["', cast(cast(value + 1 as decimal(18,2)) as TXT), '","2.00"]]}')
    when 'error' then concat('{"type":"subscriptions","channels":[{"name":"level2","product_ids":["P', cast(user_id as TXT), '"]}', case when event_id % 2 = 0 then '' else concat(',{"name":"heartbeat","product_ids":["P', cast(user_id as TXT), '"]}') end, ']}')
    when 'view' then concat('{"type":"heartbeat","product_id":"P', cast(user_id as TXT), '"}')
    when 'click' then concat('{"type":"l2update","product_id":"P', cast(user_id as TXT), '","changes":[["buy","', cast(cast(value as decimal(18,2)) as TXT), '","', case when event_id % 5 = 0 then '0' else '3.25' end, '"]]}')
    else concat('{"type":"l2update","product_id":"P', cast(case when event_id % 7 = 0 then user_id + 1 else user_id end as TXT), '","changes":[["sell","', case when event_id % 11 = 0 then 'bad' else cast(cast(value as decimal(18,2)) as TXT) end, '","1.00"]]}')
  end"""

L2_FRAMES_SQL = f"""select cast(user_id as bigint) as instrument_id,
  cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as arrival, event_id, ts,
  {L2_PAYLOAD} as payload
from events"""


def spark_text(sql: str) -> str:
    return sql.replace("TXT", "string")


def duck_text(sql: str) -> str:
    return sql.replace("TXT", "varchar")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one ordered stream per user."""
    events = table(spark, sf_dir, "events")
    return dense_arrival(events, ["user_id"], ["ts", "event_id"])


def l2_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: price-level JSON frames from ``events``. The payload is made before the rows are numbered, so
    that later filters meet a stored column and not its derivation."""
    frames = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("instrument_id"),
        "event_id",
        "ts",
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("symbol"),
        F.expr(spark_text(L2_PAYLOAD)).alias("payload"),
    )
    return dense_arrival(frames, ["instrument_id"], ["ts", "event_id"])


# V3 rendered to order-by-order JSON frames: every frame type, with missing and invalid fields.
_L3_TIME = """concat('"time":"', case when o_orderkey % 41 = 0 then '2023-02-30' else cast(cast(o_orderdate as date) as TXT) end, 'T0', cast(o_custkey % 10 as TXT), ':30:15', case when o_orderkey % 4 = 0 then '' else concat('.', cast(o_orderkey % 1000 as TXT)) end, 'Z"')"""
_L3_PRODUCT = """case when o_orderkey % 37 = 0 then '' else concat(',"product_id":"Q', cast(o_custkey % 50 + case when o_orderkey % 31 = 0 then 1 else 0 end as TXT), '"') end"""
_L3_SEQUENCE = """concat(',"sequence":', case when o_orderkey % 43 = 0 then '-5' else cast(o_orderkey + 1 as TXT) end)"""
_L3_ORDER = """case when o_orderkey % 47 = 0 then 'not-an-id' when o_orderkey % 53 = 0 then '00000000-0000-0000-0000-000000000000' else md5(cast(o_orderkey as TXT)) end"""
_L3_SIDE = """concat(',"side":"', case when o_orderkey % 59 = 0 then 'hold' when o_orderkey % 2 = 0 then 'buy' else 'sell' end, '"')"""
_L3_PRICE = """case when o_orderkey % 29 = 0 then '"1e5"' when o_orderkey % 3 = 0 then cast(cast(o_totalprice as decimal(18,2)) as TXT) else concat('"', cast(cast(o_totalprice as decimal(18,2)) as TXT), '"') end"""
_L3_SIZE = """concat('"', cast(o_custkey as TXT), '.50"')"""

L3_PAYLOAD = f"""concat('{{', {_L3_TIME}, {_L3_PRODUCT}, {_L3_SEQUENCE}, case o_orderkey % 24
    when 10 then ',"type":"heartbeat","last_trade_id":7'
    when 22 then concat(',"type":"subscriptions","channels":[{{"name":"full","product_ids":["X","Q', cast(o_custkey % 50 as TXT), '"]}}', case when o_orderkey % 48 = 22 then concat(' , {{"name":"heartbeat","product_ids":["Q', cast(o_custkey % 50 as TXT), '"]}}') else '' end, ']')
    when 11 then ',"type" : "error","message":"Failed to subscribe","reason":"bad token"'
    when 23 then case when o_orderkey % 48 = 23 then ',"type":"status"' else ',"kind":"open"' end
    else concat({_L3_SIDE}, case o_orderkey % 12
      when 0 then concat(',"type":"received","order_id":"', {_L3_ORDER}, '","size":', {_L3_SIZE}, ',"price":', {_L3_PRICE}, ',"order_type":"', case o_orderkey % 5 when 0 then 'stop' when 1 then 'iceberg' else 'limit' end, '"')
      when 1 then concat(',"type":"received","order_id":"', {_L3_ORDER}, '","funds":"3000.5","order_type":"market"')
      when 4 then concat(',"type":"done","order_id":"', {_L3_ORDER}, '","reason":"filled","remaining_size":"0","price":', {_L3_PRICE})
      when 5 then concat(',"type":"done","order_id":"', {_L3_ORDER}, '","reason":"', case when o_orderkey % 7 = 0 then 'lost' else 'canceled' end, '","remaining_size":', {_L3_SIZE}, case when o_orderkey % 5 = 0 then ',"cancel_reason":"101"' else '' end)
      when 6 then concat(',"type":"activate","order_id":"', {_L3_ORDER}, '","stop_type":"entry","stop_price":', {_L3_PRICE})
      when 7 then concat(',"type":"change","order_id":"', {_L3_ORDER}, '","new_size":', {_L3_SIZE}, ',"old_size":"9.125","price":', {_L3_PRICE})
      when 8 then concat(',"type":"match","trade_id":5,"maker_order_id":"', {_L3_ORDER}, '","taker_order_id":"', md5(cast(o_custkey as TXT)), '","size":', {_L3_SIZE}, ',"price":', {_L3_PRICE})
      when 9 then concat(',"type":"match","trade_id":6,"maker_order_id":"', {_L3_ORDER}, '","taker_order_id":"', md5(cast(o_custkey as TXT)), '","size":', {_L3_SIZE}, ',"price":', {_L3_PRICE})
      else concat(',"type":"open","order_id":"', {_L3_ORDER}, '","remaining_size":', {_L3_SIZE}, ',"price":', {_L3_PRICE}) end) end, '}}')"""

L3_FRAMES_SQL = f"""select cast(o_custkey % 50 as bigint) as instrument_id, arrival, o_orderkey, concat('Q', cast(o_custkey % 50 as TXT)) as symbol,
  {L3_PAYLOAD} as payload
from (select *, cast(row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) as bigint) as arrival from orders) o"""


def l3_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 as order-by-order JSON frames from ``orders``."""
    instrument = (F.col("o_custkey") % 50).cast("bigint")
    frames = table(spark, sf_dir, "orders").select(
        instrument.alias("instrument_id"),
        "o_orderdate",
        "o_orderkey",
        F.concat(F.lit("Q"), instrument.cast("string")).alias("symbol"),
        F.expr(spark_text(L3_PAYLOAD)).alias("payload"),
    )
    return dense_arrival(frames, ["instrument_id"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_V2_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

LEVEL_UPDATES_SQL = f"""select cast(l_suppkey as bigint) as instrument_id,
  cast(row_number() over (partition by l_suppkey order by {", ".join(_V2_ORDER)}) as bigint) as arrival,
  case when l_linestatus = 'O' then 1 else 2 end as side,
  cast(l_partkey % 20 as bigint) as level,
  cast(cast(l_extendedprice as decimal(18,2)) as TXT) as price_txt,
  cast(cast(case when l_returnflag = 'N' then 0 else l_quantity end as decimal(18,2)) as TXT) as qty_txt,
  cast(l_quantity as bigint) as latency
from lineitem"""


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: price-level updates from ``lineitem``."""
    lines = dense_arrival(table(spark, sf_dir, "lineitem"), ["l_suppkey"], _V2_ORDER)
    money = "decimal(18,2)"
    qty = F.when(F.col("l_returnflag") == "N", F.lit(0.0)).otherwise(F.col("l_quantity"))
    return lines.select(
        F.col("l_suppkey").cast("bigint").alias("instrument_id"),
        "arrival",
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("side"),
        (F.col("l_partkey") % 20).cast("bigint").alias("level"),
        F.col("l_extendedprice").cast(money).cast("string").alias("price_txt"),
        qty.cast(money).cast("string").alias("qty_txt"),
        F.col("l_quantity").cast("bigint").alias("latency"),
    )


REQUESTS_SQL = """select cast(event_id as bigint) as request_id, case when event_id % 10 = 0 then 2 else 1 end as venue,
  cast(user_id + case when event_id % 13 = 0 then 100000 else 0 end as bigint) as instrument_id,
  cast(1 + event_id % 3 as integer) as request_type, cast(1 + event_id % 6 as integer) as reason_code
from events"""


def recovery_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: recovery requests from ``events``; foreign venues and unknown instruments included."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.cast("bigint").alias("request_id"),
        F.when(event % 10 == 0, 2).otherwise(1).alias("venue"),
        (F.col("user_id") + F.when(event % 13 == 0, 100000).otherwise(0)).cast("bigint").alias("instrument_id"),
        (1 + event % 3).cast("int").alias("request_type"),
        (1 + event % 6).cast("int").alias("reason_code"),
    )


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.lit(1).alias("venue"), F.col("user_id").cast("bigint").alias("instrument_id")
    ).distinct()


DELTAS_SQL = """select cast(user_id as bigint) as instrument_id,
  cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as arrival,
  cast(row_number() over (partition by user_id order by ts, event_id)
     + sum(case when event_id % 23 = 0 then 1 else 0 end) over (partition by user_id order by ts, event_id
         rows between unbounded preceding and current row) as bigint) as seq
from events"""


def sequenced_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: deltas whose sequence has holes, from ``events``."""
    rows = event_arrivals(spark, sf_dir).select(F.col("user_id").cast("bigint").alias("instrument_id"), "arrival", "event_id")
    holes = running(rows, Lane(), _holes=sum_upto((F.col("event_id") % 23 == 0).cast("bigint")))
    return holes.select("instrument_id", "arrival", (F.col("arrival") + F.col("_holes")).alias("seq"))


LIFECYCLE_SQL = """select cast(row_number() over (partition by instrument_id order by event_at, src, k1, k2, k3, k4, k5) as bigint) as arrival,
  cast(instrument_id as bigint) as instrument_id, cast(order_ref as bigint) as order_ref, kind, qty, old_qty
from (
  select o_orderkey % 50 as instrument_id, o_orderkey % 500 as order_ref, o_orderdate as event_at, 0 as src,
    o_orderkey as k1, cast(0 as bigint) as k2, cast(0 as bigint) as k3, cast(0 as decimal(18,2)) as k4, cast(0 as decimal(18,2)) as k5,
    case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'change' end as kind,
    cast(o_custkey as decimal(18,2)) as qty, cast(o_custkey % 7 as decimal(18,2)) as old_qty from orders
  union all
  select l_orderkey % 50, l_orderkey % 500, l_shipdate, 1, l_orderkey, cast(l_linenumber as bigint), l_partkey,
    cast(l_extendedprice as decimal(18,2)), cast(l_quantity as decimal(18,2)), 'match', cast(l_quantity as decimal(18,2)),
    cast(null as decimal(18,2)) from lineitem
) x"""


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: order lifecycle and trades as one stream per instrument, from ``orders`` and ``lineitem``."""
    money = "decimal(18,2)"
    zero, none = F.lit(0).cast("bigint"), F.lit(0).cast(money)
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 50).alias("instrument_id"), (F.col("o_orderkey") % 500).alias("order_ref"),
        F.col("o_orderdate").alias("event_at"), F.lit(0).alias("src"), F.col("o_orderkey").alias("k1"),
        zero.alias("k2"), zero.alias("k3"), none.alias("k4"), none.alias("k5"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("change").alias("kind"),
        F.col("o_custkey").cast(money).alias("qty"), (F.col("o_custkey") % 7).cast(money).alias("old_qty"),
    )
    matches = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("instrument_id"), (F.col("l_orderkey") % 500).alias("order_ref"),
        F.col("l_shipdate").alias("event_at"), F.lit(1).alias("src"), F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").cast("bigint").alias("k2"), F.col("l_partkey").alias("k3"),
        F.col("l_extendedprice").cast(money).alias("k4"), F.col("l_quantity").cast(money).alias("k5"),
        F.lit("match").alias("kind"), F.col("l_quantity").cast(money).alias("qty"), F.lit(None).cast(money).alias("old_qty"),
    )
    both = orders.unionByName(matches)
    numbered = dense_arrival(both, ["instrument_id"], ["event_at", "src", "k1", "k2", "k3", "k4", "k5"])
    return numbered.select("arrival", "instrument_id", "order_ref", "kind", "qty", "old_qty")


# V7: one feed with every kind of row, from ``events``. Deltas carry a sequence with holes; a document's boundary
# lies up to two deltas back, or one ahead.
FEED_KIND = """case event_type when 'signup' then case when event_id % 11 = 0 then 'bad_snapshot' else 'snapshot' end
    when 'error' then case event_id % 12 when 0 then 'disconnect' when 1 then 'request' when 2 then 'error' when 3 then 'trigger'
      when 4 then 'recovery_failed' when 5 then 'ack' else 'update' end
    when 'view' then case when event_id % 3 = 0 then 'update' else 'heartbeat' end
    else case when event_id % 4 = 0 then 'trade' else 'update' end end"""
_FEED_STEP = "case when kind in ('update', 'trade') then case when event_id % 31 = 0 then 2 else 1 end else 0 end"
_FEED_SEQ = """case when kind in ('update', 'trade') then {n} when kind = 'snapshot' then {n} - event_id % 3 + case when event_id % 17 = 0 then 2 else 0 end end"""
# What a delta says about an order (V7): a match reduces, the others set or remove.
FEED_ORDER = "case event_id % 7 when 0 then 'done' when 1 then 'change' when 2 then 'match' when 3 then 'received' else 'open' end"

MERGED_FEED_SQL = f"""select instrument_id, arrival, event_id, at_ns, kind, cast({_FEED_SEQ.format(n="n")} as bigint) as seq
from (select *, sum({_FEED_STEP}) over (partition by instrument_id order by arrival rows unbounded preceding) as n
  from (select cast(user_id as bigint) as instrument_id, event_id, epoch_us(ts) * 1000 as at_ns, {FEED_KIND} as kind,
      cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as arrival from events) e) f"""


def merged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: deltas, documents, signals and triggers of every instrument in one stream."""
    rows = event_arrivals(spark, sf_dir).select(
        F.col("user_id").cast("bigint").alias("instrument_id"), "arrival", "event_id", ntz_nanos(F.col("ts")).alias("at_ns"),
        F.expr(FEED_KIND).alias("kind"),
    )
    counted = running(rows, Lane(), _n=sum_upto(F.expr(_FEED_STEP).cast("bigint")))
    seq = F.expr(f"cast({_FEED_SEQ.format(n='_n')} as bigint)").alias("seq")
    return counted.select("instrument_id", "arrival", "event_id", "at_ns", "kind", seq)
