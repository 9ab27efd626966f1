"""Queries over level updates (V2), sequenced deltas (V5), order lifecycles (V6) and requests (V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import decode_code, fixed_point, ntz_nanos
from feedlake.operators import counters
from feedlake.operators.align import align_deltas, align_segments, alignment_summary, buffer_overflow, replay_order, sequence_gaps
from feedlake.operators.book import change_conflicts, level_book, maker_fills, resting_orders, session_book
from feedlake.operators.counters import count_if
from feedlake.operators.l2 import classify_l2, flatten_levels
from feedlake.operators.liveness import liveness_timeouts
from feedlake.operators.ordering import Lane
from feedlake.operators.recovery import batch_result, duplicate_routes, route_requests
from feedlake.operators.session_state import apply_session_rules
from feedlake.plans.oracle import L2_KINDS, L2_RULES, UPTO
from feedlake.plans.registration import Family
from feedlake.plans.views import (
    DELTAS_SQL,
    LEVEL_UPDATES_SQL,
    LIFECYCLE_SQL,
    REQUESTS_SQL,
    connectors,
    duck_text,
    event_arrivals,
    l2_frames,
    level_updates,
    order_lifecycle,
    recovery_requests,
    sequenced_deltas,
    table,
)

FAMILY = Family()
register = FAMILY.register

V2 = f"v as ({duck_text(LEVEL_UPDATES_SQL)})"
_AS_LEVELS = """p as (select *, cast(replace(qty_txt, '.', '') as bigint) as qty_m from v)"""


def _level_rows(spark, sf_dir):
    """V2 rows as level entries; the level number is the price."""
    v = level_updates(spark, sf_dir).withColumn("q", fixed_point(F.col("qty_txt")))
    return v.select(
        "instrument_id", "arrival", "side", F.lit(0).alias("entry_pos"),
        F.when(F.col("q.m") == 0, 2).otherwise(1).alias("action"),
        F.col("level").alias("price_m"), F.lit(0).alias("price_s"),
        F.col("q.m").alias("qty_m"), F.col("q.s").alias("qty_s"),
    )


def _book_sql(where: str = "") -> str:
    return f"""with {V2}, {_AS_LEVELS},
r as (select *, row_number() over (partition by instrument_id, side, level order by arrival desc) as age from p {where})
select instrument_id, side, cast(level as decimal(38,18)) as price, level as price_m, 0 as price_s, qty_m, 2 as qty_s
from r where age = 1 and qty_m <> 0"""


@register("b1_level_book", _book_sql())
def b1_level_book(spark, sf_dir):
    return level_book(_level_rows(spark, sf_dir), "instrument_id")


@register("b4_level_book_at", _book_sql("where arrival <= 40"))
def b4_level_book_at(spark, sf_dir):
    return level_book(_level_rows(spark, sf_dir), "instrument_id", until=40)


@register(
    "b1_session_book",
    f"""with {L2_RULES}, latest as (select instrument_id, max(session_id) as newest from r group by instrument_id),
e as (select r.instrument_id, r.arrival, r.kind, r.event_id, ev.event_type, ev.value from r join latest l on r.instrument_id = l.instrument_id
  and r.session_id = l.newest join events ev on ev.event_id = r.event_id where pub = 1),
lv as (select instrument_id, arrival, 0 as pos, 1 as side, cast(cast(value as decimal(18,2)) * 100 as bigint) as pm, cast(150 as bigint) as qm, 2 as qs from e where kind = 'snapshot'
  union all select instrument_id, arrival, 1, 2, cast(cast(value + 1 as decimal(18,2)) * 100 as bigint), 200, 2 from e where kind = 'snapshot'
  union all select instrument_id, arrival, 0, case when event_type = 'click' then 1 else 2 end, cast(cast(value as decimal(18,2)) * 100 as bigint),
    case when event_type <> 'click' then 100 when event_id % 5 = 0 then 0 else 325 end,
    case when event_type = 'click' and event_id % 5 = 0 then 0 else 2 end from e where kind = 'update'),
a as (select *, row_number() over (partition by instrument_id, side, pm order by arrival desc, pos desc) as age from lv)
select instrument_id, side, cast(pm as decimal(38,18)) / 100 as price, pm as price_m, 2 as price_s, qm as qty_m, qs as qty_s from a where age = 1 and qm <> 0""".replace(
        "cast(pm as decimal(38,18)) / 100 as price", "cast(cast(pm as decimal(20,2)) * 0.01 as decimal(38,18)) as price"
    ),
)
def b1_session_book(spark, sf_dir):
    """The book of each instrument's newest session, from JSON frames to levels."""
    rows = apply_session_rules(
        classify_l2(l2_frames(spark, sf_dir)).select("instrument_id", "arrival", "kind", "levels")
    )
    levels = flatten_levels(rows.where("publishable"), "instrument_id", "session_id", "arrival")
    return session_book(levels, rows.select("instrument_id", "session_id"), "instrument_id")


@register(
    "f1_fixed_point",
    f"with {V2} select instrument_id, arrival, cast(replace(price_txt, '.', '') as bigint) as m, 2 as s from v",
)
def f1_fixed_point(spark, sf_dir):
    v = level_updates(spark, sf_dir).withColumn("p", fixed_point(F.col("price_txt")))
    return v.select("instrument_id", "arrival", F.col("p.m").alias("m"), F.col("p.s").alias("s"))


@register(
    "a5_latency",
    f"""with {V2}, x as (select instrument_id, arrival, latency % 9 as lat from v),
z as (select *, max(case when lat = 0 then arrival end) over (partition by instrument_id) as last_zero from x)
select instrument_id, coalesce(min(case when last_zero is null or arrival > last_zero then lat end), 0) as latency_min,
  max(lat) as latency_max, arg_max(lat, arrival) as latency_last from z group by instrument_id""",
)
def a5_latency(spark, sf_dir):
    samples = level_updates(spark, sf_dir).select("instrument_id", "arrival", (F.col("latency") % 9).alias("latency"))
    return counters.latency_stats(samples, Lane())


@register(
    "a6_connections",
    """with e as (select *, row_number() over (partition by user_id order by ts, event_id) as arrival,
  case event_type when 'signup' then 1 when 'error' then 0 end as st from events),
s as (select *, coalesce(lag(st) over (partition by user_id order by arrival), 0) as prev from e where st is not null)
select user_id as instrument_id, count(*) filter (where st = 1 and prev = 0) as opens,
  count(*) filter (where st = 0 and prev = 1) as closes,
  cast(sum(case when st <> prev then st * 2 - 1 else 0 end) as bigint) as active_connections from s group by user_id""",
)
def a6_connections(spark, sf_dir):
    edges = event_arrivals(spark, sf_dir).select(F.col("user_id").alias("instrument_id"), "arrival", "event_type")
    kind = F.col("event_type")
    return counters.active_connections(edges, Lane(), kind == "signup", kind == "error")


@register(
    "a6_connection_attempts",
    """select user_id as instrument_id, count(*) filter (where event_type = 'signup') as connection_attempts,
  count(*) filter (where event_type = 'view') as connection_successes,
  count(*) filter (where event_type = 'error') as connection_failures,
  count(*) filter (where event_type = 'click') as reconnect_attempts from events group by user_id""",
)
def a6_connection_attempts(spark, sf_dir):
    event = F.col("event_type")
    named = F.when(event == "signup", "attempt").when(event == "view", "success").when(event == "error", "failure")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instrument_id"), named.when(event == "click", "reconnect").alias("event")
    )
    return counters.connection_accounting(rows, "instrument_id")


_ROUTED = f"""with q as ({REQUESTS_SQL}), c as (select distinct user_id as instrument_id from events),
o as (select q.*, case when q.venue = 1 and c.instrument_id is not null then 'accepted'
  when q.venue = 1 then 'unknown' else 'rejected' end as outcome from q left join c using (instrument_id))"""


def _routed(spark, sf_dir):
    return route_requests(recovery_requests(spark, sf_dir), connectors(spark, sf_dir), own_venue=1)


@register(
    "j2_recovery_routing",
    f"""{_ROUTED} select request_id, venue, instrument_id, outcome,
  case request_type when 1 then 'RESET' when 2 then 'RESNAPSHOT' else 'RESYNC' end as request_name,
  case reason_code when 1 then 'STREAM_INTEGRITY_FAILURE' when 2 then 'OUT_OF_ORDER_OR_INVALID_TRANSITION' when 3 then 'STATE_CORRUPTION'
    when 4 then 'CHECK_FAILED' when 5 then 'HEARTBEAT_TIMEOUT' else 'MANUAL_RESET' end as reason_name from o""",
)
def j2_recovery_routing(spark, sf_dir):
    return _routed(spark, sf_dir).select(
        "request_id",
        "venue",
        "instrument_id",
        "outcome",
        decode_code("request_type", F.col("request_type")).alias("request_name"),
        decode_code("request_reason", F.col("reason_code")).alias("reason_name"),
    )


@register(
    "j3_duplicate_routes",
    """select venue, instrument_id, count(*) as connectors from (select case when s_suppkey % 2 = 0 then 1 else 2 end as venue,
  cast(s_suppkey % 70 as bigint) as instrument_id from supplier) x group by venue, instrument_id having count(*) > 1""",
)
def j3_duplicate_routes(spark, sf_dir):
    key = F.col("s_suppkey")
    return duplicate_routes(
        table(spark, sf_dir, "supplier").select(
            F.when(key % 2 == 0, 1).otherwise(2).alias("venue"), (key % 70).cast("bigint").alias("instrument_id")
        )
    )


@register(
    "a8_batch_result",
    f"""{_ROUTED} select request_type, reason_code, count(*) as decoded, count(*) filter (where outcome = 'accepted') as accepted,
  count(*) filter (where outcome = 'rejected') as rejected, count(*) filter (where outcome = 'unknown') as unknown_instrument,
  cast(0 as bigint) as malformed from o group by request_type, reason_code""",
)
def a8_batch_result(spark, sf_dir):
    return batch_result(_routed(spark, sf_dir), "request_type", "reason_code")


# The snapshot boundary is 5 for every instrument; every seventh instrument starts one later.
_ALIGNED = f"""with d as ({DELTAS_SQL}), s as (select distinct user_id as instrument_id, 5 + case when user_id % 7 = 0 then 2 else 0 end as boundary from events),
j as (select d.*, s.boundary, min(case when seq > boundary then arrival end) over (partition by d.instrument_id) as first_live,
  lag(seq) over (partition by d.instrument_id order by arrival) as prev from d join s using (instrument_id)),
g as (select *, case when arrival >= first_live and seq <> case when arrival = first_live then boundary else prev end + 1 then 1 else 0 end as gap from j),
c as (select *, sum(gap) over (partition by instrument_id {UPTO}) as gaps from g),
o as (select instrument_id, arrival, seq, case when first_live is null or arrival < first_live then 'stale' when gaps = 0 then 'replayed'
  when gap = 1 and gaps = 1 then 'gap' else 'dropped' end as outcome from c)"""


def _boundaries(spark, sf_dir):
    instruments = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("instrument_id")).distinct()
    return instruments.withColumn("boundary", 5 + F.when(F.col("instrument_id") % 7 == 0, 2).otherwise(0))


def _aligned(spark, sf_dir):
    return align_deltas(sequenced_deltas(spark, sf_dir), _boundaries(spark, sf_dir))


@register("w6_j4_alignment", f"{_ALIGNED} select instrument_id, arrival, seq, outcome from o")
def w6_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir).select("instrument_id", "arrival", "seq", "outcome")


@register(
    "w6_alignment_summary",
    f"""{_ALIGNED} select instrument_id, count(*) filter (where outcome = 'stale') as stale, count(*) filter (where outcome = 'replayed') as replayed,
  count(*) filter (where outcome = 'gap') as gap, count(*) filter (where outcome = 'dropped') as dropped,
  max(case when outcome = 'replayed' then seq end) as last_seq from o group by instrument_id""",
)
def w6_alignment_summary(spark, sf_dir):
    return alignment_summary(_aligned(spark, sf_dir), "instrument_id")


# Every eleventh row may be a snapshot instead: up to five of them, by instrument, some of them behind the deltas.
_SNAPSHOT_ROW = "arrival % 11 = 0 and arrival div 11 <= instrument_id % 6"
_BOUNDARY = "seq - case when arrival % 3 = 0 then 4 else arrival % 2 end"


@register(
    "w6_segments",
    f"""with d as ({DELTAS_SQL}), s as (select instrument_id, arrival as snapshot_at, {_BOUNDARY} as boundary from d where {_SNAPSHOT_ROW.replace(" div ", " // ")}),
w as (select d.*, s.snapshot_at, cast(s.boundary as bigint) as boundary from (select * from d where not ({_SNAPSHOT_ROW.replace(" div ", " // ")})) d
  asof left join s on d.instrument_id = s.instrument_id and d.arrival < s.snapshot_at),
j as (select *, min(case when seq > boundary then arrival end) over p as first_live, count(*) over p as held,
  lag(seq) over (partition by instrument_id, snapshot_at order by arrival) as prev from w window p as (partition by instrument_id, snapshot_at)),
g as (select *, case when arrival >= first_live and seq <> case when arrival = first_live then boundary else prev end + 1 then 1 else 0 end as gap from j),
c as (select *, sum(gap) over (partition by instrument_id, snapshot_at {UPTO}) as gaps from g)
select instrument_id, arrival, seq, snapshot_at, boundary, case when snapshot_at is null then 'pending' when held > 9 then 'overflow'
  when first_live is null or arrival < first_live then 'stale' when gaps = 0 then 'replayed' when gap = 1 and gaps = 1 then 'gap' else 'dropped' end as outcome from c""",
)
def w6_segments(spark, sf_dir):
    """0 to 5 snapshots per instrument and a buffer of ten slots, cut per segment (J4, W6, W7)."""
    rows = sequenced_deltas(spark, sf_dir)
    snapshots = rows.where(_SNAPSHOT_ROW).selectExpr("instrument_id", "arrival", f"cast({_BOUNDARY} as bigint) as boundary")
    aligned = align_segments(rows.where(f"not ({_SNAPSHOT_ROW})"), snapshots, slots=10)
    return aligned.select("instrument_id", "arrival", "seq", "snapshot_at", "boundary", "outcome")


@register(
    "w12_replay_order",
    f"""{_ALIGNED} select instrument_id, 0 as stage, cast(null as bigint) as arrival, cast(boundary as bigint) as seq, cast(0 as bigint) as replay_pos from s
union all select instrument_id, 1, arrival, seq, row_number() over (partition by instrument_id order by arrival) from o where outcome = 'replayed'""",
)
def w12_replay_order(spark, sf_dir):
    return replay_order(_aligned(spark, sf_dir), _boundaries(spark, sf_dir), "instrument_id")


@register(
    "w7_buffer_overflow",
    f"""with d as ({DELTAS_SQL}), s as (select distinct user_id as instrument_id, 20 + user_id % 60 as taken from events)
select instrument_id, count(*) as buffered, count(*) > 49 as overflow from d join s using (instrument_id) where arrival < taken group by instrument_id""",
)
def w7_buffer_overflow(spark, sf_dir):
    """Buffer of 50 slots; the snapshot of each instrument arrives at position 20 to 79."""
    ident = F.col("instrument_id")
    snapshots = (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").cast("bigint").alias("instrument_id"))
        .distinct()
        .withColumn("arrival", 20 + ident % 60)
    )
    return buffer_overflow(sequenced_deltas(spark, sf_dir), snapshots, slots=50)


@register(
    "w9_sequence_gaps",
    f"""with d as ({DELTAS_SQL}), x as (select instrument_id, arrival, case when arrival % 17 = 0 then seq - 3 else seq end as seq from d),
l as (select *, lag(seq) over (partition by instrument_id order by arrival) as prev_seq from x)
select instrument_id, arrival, seq, prev_seq, case when seq > prev_seq + 1 then seq - prev_seq - 1 else 0 end as missing,
  coalesce(seq <= prev_seq, false) as out_of_order from l""",
)
def w9_sequence_gaps(spark, sf_dir):
    late = F.when(F.col("arrival") % 17 == 0, F.col("seq") - 3).otherwise(F.col("seq"))
    return sequence_gaps(sequenced_deltas(spark, sf_dir).withColumn("seq", late))


V6 = f"e as ({LIFECYCLE_SQL})"
_RESTING = """a as (select *, max(case when kind <> 'match' then arrival end) over (partition by instrument_id, order_ref) as last_abs from e)
select instrument_id, order_ref, max(case when arrival = last_abs then kind end) as last_kind,
  cast(max(case when arrival = last_abs then qty end) - coalesce(sum(case when kind = 'match' and arrival > last_abs then qty end), 0) as decimal(18,2)) as resting_qty
from a where last_abs is not null group by instrument_id, order_ref having max(case when arrival = last_abs then kind end) <> 'done'"""


@register("b2_resting_orders", f"with {V6}, {_RESTING}")
def b2_resting_orders(spark, sf_dir):
    return resting_orders(order_lifecycle(spark, sf_dir))


@register("b4_resting_orders_at", f"with e0 as ({LIFECYCLE_SQL}), e as (select * from e0 where arrival <= 700), {_RESTING}")
def b4_resting_orders_at(spark, sf_dir):
    return resting_orders(order_lifecycle(spark, sf_dir), until=700)


# The last absolute row of the order is carried by a window, together with what was sold up to it.
_ORDER = "over (partition by instrument_id, order_ref order by arrival rows between unbounded preceding and 1 preceding)"
_STATE = f"""with {V6},
w as (select *, coalesce(sum(case when kind = 'match' then qty end) {_ORDER}, 0) as sold from e),
x as (select *, last_value(case when kind <> 'match' then struct_pack(k := kind, q := qty, s := sold) end ignore nulls) {_ORDER} as l from w),
s as (select *, case when l.k <> 'done' then cast(l.q - (sold - l.s) as decimal(38,2)) end as current_qty from x)"""


@register(
    "b3_change_conflicts",
    f"""{_STATE} select instrument_id, count(*) as conflicts, count(current_qty) as resting, min(arrival) as first_conflict
from s where kind = 'change' and old_qty is distinct from current_qty group by instrument_id""",
)
def b3_change_conflicts(spark, sf_dir):
    return (
        change_conflicts(order_lifecycle(spark, sf_dir))
        .groupBy("instrument_id")
        .agg(
            F.count("*").alias("conflicts"),
            F.count("current_qty").alias("resting"),
            F.min("arrival").alias("first_conflict"),
        )
    )


@register(
    "j5_maker_fills",
    f"""{_STATE} select instrument_id, arrival, order_ref, qty, cast(current_qty as decimal(18,2)) as current_qty,
  cast(current_qty - qty as decimal(18,2)) as remaining_qty from s where kind = 'match'""",
)
def j5_maker_fills(spark, sf_dir):
    money = "decimal(18,2)"
    return maker_fills(order_lifecycle(spark, sf_dir)).select(
        "instrument_id",
        "arrival",
        "order_ref",
        "qty",
        F.col("current_qty").cast(money).alias("current_qty"),
        F.col("remaining_qty").cast(money).alias("remaining_qty"),
    )


TIMEOUT = 12 * 3600 * 1_000_000_000


def _liveness_sql(timeout: int) -> str:
    """Row by row: a step of the recursion either fires the next check or takes the next row."""
    half = timeout // 2
    return f"""with recursive {L2_KINDS},
hz as (select max(epoch_us(ts)) * 1000 + 1 as h from events),
rows_ as (select instrument_id, kind, epoch_us(ts) * 1000 as tm, row_number() over (partition by instrument_id order by arrival) as i from k
  union all select instrument_id, 'end', (select h from hz), count(*) + 1 from k group by instrument_id),
walk as (
  select distinct instrument_id, cast(1 as bigint) as i, 0 as opened, 0 as recovering, cast(null as bigint) as start, cast(null as bigint) as seen,
    cast(null as bigint) as fired_ns, cast(null as bigint) as since_ns, false as applied from k
  union all
  select instrument_id, case when fires then i else i + 1 end,
    case when fires or trig then 0 when kind = 'snapshot' then 1 else opened end,
    case when fires or trig then 1 when kind = 'snapshot' then 0 else recovering end,
    case when (fires or trig) and recovering = 0 then null when not fires and kind = 'ack' then coalesce(start, tm) else start end,
    case when fires then chk when kind in ('ack', 'heartbeat') then tm else seen end,
    case when fires then chk end, case when fires then seen end, fires and recovering = 0
  from (select *, coalesce(chk < tm, false) as fires, kind = 'trigger' or (kind in ('snapshot', 'bad_snapshot') and opened = 1) as trig
    from (select w.*, r.kind, r.tm, w.start + {timeout} + greatest(0, (w.seen - w.start + {half} - 1) // {half}) * {half} as chk
      from walk w join rows_ r on r.instrument_id = w.instrument_id and r.i = w.i) x) y)
select instrument_id, fired_ns, since_ns, applied from walk where fired_ns is not null"""


@register("w8_liveness_timeouts", _liveness_sql(TIMEOUT))
def w8_liveness(spark, sf_dir):
    """Twelve-hour timeout over V1; silence at the end of the data counts up to its last frame."""
    frames = classify_l2(l2_frames(spark, sf_dir)).select(
        "instrument_id", "arrival", "kind", ntz_nanos(F.col("ts")).alias("at_ns")
    )
    horizon = table(spark, sf_dir, "events").agg(F.max(ntz_nanos(F.col("ts")))).first()[0] + 1
    return liveness_timeouts(frames, TIMEOUT, F.lit(horizon))


@register(
    "a3_liveness_accounting",
    f"""with fired as ({_liveness_sql(TIMEOUT)}) select instrument_id, count(*) as heartbeats_missed, count(*) as liveness_failures,
  count(*) filter (where applied) as liveness_recoveries from fired group by instrument_id""",
)
def a3_liveness_accounting(spark, sf_dir):
    fired = w8_liveness(spark, sf_dir)
    return fired.groupBy("instrument_id").agg(
        F.count("*").alias("heartbeats_missed"),
        F.count("*").alias("liveness_failures"),
        F.count_if("applied").alias("liveness_recoveries"),
    )


@register(
    "a3_gap_accounting",
    f"""{_ALIGNED} select instrument_id, count(*) filter (where outcome = 'gap') as sequence_gaps_detected from o group by instrument_id""",
)
def a3_gap_accounting(spark, sf_dir):
    return (
        _aligned(spark, sf_dir)
        .groupBy("instrument_id")
        .agg(count_if(F.col("outcome") == "gap").alias("sequence_gaps_detected"))
    )
