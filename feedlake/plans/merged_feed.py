"""Queries over the merged feed (V7): all triggers, the sessions they make, and what they leave of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators.book import session_orders
from feedlake.operators.session_feed import FeedRules, feed_events, session_feed, trigger_table
from feedlake.plans.registration import Family
from feedlake.plans.views import FEED_ORDER, MERGED_FEED_SQL, merged_feed, table

FAMILY = Family()
register = FAMILY.register

SLOTS = 6
TIMEOUT = 36 * 3600 * 1_000_000_000
RULES = FeedRules(buffered=True, timeout=TIMEOUT, restart=True, slots=SLOTS)

# Row by row: a step of the recursion either fires the next check or takes the next row.
_LIVE = "list_filter(ring, lambda x: x.q > seq)[1].p"
WALK = f"""with recursive v as ({MERGED_FEED_SQL}),
rows_ as (select instrument_id, arrival, kind, at_ns as tm, seq, row_number() over (partition by instrument_id order by arrival) as i from v),
walk as (
  select distinct instrument_id, cast(1 as bigint) as i, 0 as opened, 0 as rec, 1 as buf, cast([] as struct(p bigint, q bigint)[]) as ring,
    cast(null as bigint) as start, cast(null as bigint) as seen, cast(0 as bigint) as session_id,
    cast(null as bigint) as pos, cast(null as bigint) as at_ns, cast(null as varchar) as cause, false as applied,
    cast(null as bigint) as doc_at, cast(null as bigint) as boundary, cast(null as bigint) as live_from, cast(null as bigint) as gap_at from v
  union all
  select instrument_id, case when fires then i else i + 1 end,
    case when applied then 0 when snap then 1 else opened end,
    case when applied then 1 when (snap and gap is null) or (not fires and kind = 'recovery_failed') then 0 else rec end,
    case when applied then 1 when snap or full_ or refused then 0 else buf end,
    case when applied or snap or full_ or refused then [] when delta and buf = 1 then list_append(ring, struct_pack(p := arrival, q := seq)) else ring end,
    case when applied or (not fires and kind = 'disconnect') then case when start is not null then now_ end
      when not fires and kind in ('ack', 'heartbeat') then coalesce(start, tm) else start end,
    case when fires then chk when kind in ('ack', 'heartbeat') then tm else seen end,
    session_id + case when applied then 1 else 0 end,
    case when fires then arrival - 1 when cause is not null then arrival end, case when cause is not null then now_ end,
    case when cause = 'disconnect' and rec = 1 then null else cause end, applied,
    case when snap then arrival end, case when snap then seq end, case when snap then live end, case when snap then gap end
  from (select *, cause is not null and rec = 0 as applied, case when fires then chk else tm end as now_
    from (select *, case when fires then 'timeout' when full_ then 'overflow' when gap is not null then 'gap' when refused then 'refused'
        when kind in ('trigger', 'error', 'disconnect', 'request') then kind end as cause
      from (select *, case when snap then list_filter(tail, lambda x, i: x.q <> case when i = 1 then seq else tail[i - 1].q end + 1)[1].p end as gap
        from (select *, case when snap then list_filter(ring, lambda x: x.p >= live) end as tail
          from (select *, case when snap then {_LIVE} end as live,
              delta and buf = 1 and len(ring) >= {SLOTS - 1} as full_, not fires and kind = 'bad_snapshot' and buf = 1 as refused
            from (select *, not fires and kind in ('update', 'trade') as delta, not fires and kind = 'snapshot' and buf = 1 as snap
              from (select *, coalesce(chk < tm, false) as fires
                from (select w.instrument_id, w.i, w.opened, w.rec, w.buf, w.ring, w.start, w.seen, w.session_id, r.arrival, r.kind, r.tm, r.seq,
                    w.start + {TIMEOUT} + greatest(0, (w.seen - w.start + {TIMEOUT // 2} - 1) // {TIMEOUT // 2}) * {TIMEOUT // 2} as chk
                  from walk w join rows_ r on r.instrument_id = w.instrument_id and r.i = w.i) a) b) c) d) e) f) g) h),
log as (select instrument_id, pos, session_id, at_ns, cause, applied from walk where cause is not null),
docs as (select instrument_id, doc_at, boundary, live_from, gap_at, cause,
  session_id - case when cause is not null and applied then 1 else 0 end as session_id from walk where doc_at is not null),
starts as (select instrument_id, session_id, pos as from_pos, cause from log where applied
  union all select distinct instrument_id, cast(0 as bigint), cast(-1 as bigint), cast(null as varchar) from v),
sessions as (select s.*, d.doc_at, d.boundary, d.live_from, d.gap_at from starts s left join docs d using (instrument_id, session_id)),
placed as (select v.*, s.session_id, s.doc_at, s.live_from, s.gap_at from v asof join sessions s
  on v.instrument_id = s.instrument_id and v.arrival > s.from_pos),
judged as (select *, case when kind in ('update', 'trade') then case when doc_at is null then 'pre_snapshot' when arrival > doc_at then 'published'
      when live_from is null or arrival < live_from then 'stale' when gap_at is null or arrival < gap_at then 'replayed'
      when arrival = gap_at then 'gap' else 'dropped' end
    when kind = 'snapshot' then case when arrival = doc_at then 'accepted_snapshot' else 'ignored_snapshot' end else kind end as disposition from placed),
feed as (select *, case when disposition = 'accepted_snapshot' then 1 when disposition in ('replayed', 'published') then 1 +
    count(*) filter (where disposition in ('replayed', 'published')) over (partition by instrument_id, session_id order by arrival rows unbounded preceding) end as gateway_seq
  from judged)"""


def _events(spark, sf_dir):
    feed = merged_feed(spark, sf_dir)
    return feed, feed_events(feed, RULES)


@register(
    "w3_all_triggers",
    f"""{WALK} select instrument_id, pos as arrival, session_id, at_ns, 'RESET' as request_type, case cause when 'timeout' then 'HEARTBEAT_TIMEOUT'
  when 'request' then 'MANUAL_RESET' else 'STREAM_INTEGRITY_FAILURE' end as reason_code, cause as text,
  case when applied then 'applied' else 'ignored' end as outcome from log""",
)
def all_triggers(spark, sf_dir):
    """Timeouts, holes, overflows, refused documents, requests, errors and disconnects in one table."""
    return trigger_table(_events(spark, sf_dir)[1], "instrument_id", "arrival")


@register(
    "l3_session_feed",
    f"{WALK} select instrument_id, arrival, kind, seq, session_id, disposition, cast(gateway_seq as bigint) as gateway_seq from feed",
)
def l3_session_feed(spark, sf_dir):
    """Every row with its session, its outcome and its sequence of its own (W5)."""
    feed, events = _events(spark, sf_dir)
    return session_feed(feed, events).select("instrument_id", "arrival", "kind", "seq", "session_id", "disposition", "gateway_seq")


@register(
    "l3_session_messages",
    f"""{WALK} select instrument_id, session_id, 1 as event_type, cast(0 as bigint) as gateway_seq, cast(0 as bigint) as seq1, from_pos as arrival from starts where session_id > 0
union all select instrument_id, session_id, case when kind = 'snapshot' then 2 when kind = 'trade' then 4 else 3 end, cast(gateway_seq as bigint), seq, arrival
from feed where gateway_seq is not null""",
)
def l3_session_messages(spark, sf_dir):
    """Resets, documents, order events and trades as one message table; the exchange's own sequence travels along."""
    feed, events = _events(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    resets = events.where("applied").select("instrument_id", "session_id", F.lit(1).alias("event_type"), zero.alias("gateway_seq"), zero.alias("seq1"), "arrival")
    rows = session_feed(feed, events).where("gateway_seq is not null")
    event = F.when(F.col("kind") == "snapshot", 2).when(F.col("kind") == "trade", 4).otherwise(3)
    return resets.unionByName(rows.select("instrument_id", "session_id", event.alias("event_type"), "gateway_seq", F.col("seq").alias("seq1"), "arrival"))


@register(
    "a3_feed_recovery_accounting",
    f"""{WALK}, l as (select instrument_id, count(*) filter (where applied) as recovery_attempts, count(*) filter (where not applied) as recovery_requests_ignored_in_progress,
    count(*) filter (where cause = 'gap') as sequence_gaps_detected, count(*) filter (where cause = 'overflow') as overflow_rejections,
    count(*) filter (where cause = 'timeout') as heartbeats_missed from log group by instrument_id),
m as (select instrument_id, count(*) filter (where disposition = 'accepted_snapshot') as book_snapshot_published,
    count(gateway_seq) as sequenced, count(*) filter (where kind = 'recovery_failed') as recovery_failures from feed group by instrument_id)
select m.instrument_id, coalesce(recovery_attempts, 0) as recovery_attempts, coalesce(recovery_requests_ignored_in_progress, 0) as recovery_requests_ignored_in_progress,
  coalesce(sequence_gaps_detected, 0) as sequence_gaps_detected, coalesce(overflow_rejections, 0) as overflow_rejections,
  coalesce(heartbeats_missed, 0) as heartbeats_missed, book_snapshot_published, recovery_failures,
  sequenced + coalesce(recovery_attempts, 0) as messages_published from m left join l using (instrument_id)""",
)
def feed_recovery_accounting(spark, sf_dir):
    """Recovery counters of the whole feed, with the three that need it: overflows, documents and messages."""
    feed, events = _events(spark, sf_dir)
    asked, cause = F.col("event") == "trigger", F.col("cause")
    told = events.groupBy("instrument_id").agg(
        F.count_if(asked & F.col("applied")).alias("recovery_attempts"),
        F.count_if(asked & ~F.col("applied")).alias("recovery_requests_ignored_in_progress"),
        F.count_if(asked & (cause == "gap")).alias("sequence_gaps_detected"),
        F.count_if(asked & (cause == "overflow")).alias("overflow_rejections"),
        F.count_if(asked & (cause == "timeout")).alias("heartbeats_missed"),
    )
    rows = session_feed(feed, events).groupBy("instrument_id").agg(
        F.count_if(F.col("disposition") == "accepted_snapshot").alias("book_snapshot_published"),
        F.count("gateway_seq").alias("_sequenced"),
        F.count_if(F.col("kind") == "recovery_failed").alias("recovery_failures"),
    )
    both = rows.join(told, "instrument_id", "left").na.fill(0)
    return both.withColumn("messages_published", F.col("_sequenced") + F.col("recovery_attempts")).drop("_sequenced")


_IMAGE = "(event_id + i * 5) % 9 as order_ref, cast(10 * i + event_id % 10 as decimal(18,2)) as qty"


def images(spark, sf_dir):
    """The orders of every document: 0 to 3 of them."""
    rows = merged_feed(spark, sf_dir).where("kind = 'snapshot' and event_id % 4 > 0")
    listed = rows.selectExpr("instrument_id", "arrival", "event_id", "explode(sequence(1L, event_id % 4)) as i")
    return listed.selectExpr("instrument_id", "arrival", _IMAGE.split(" as order_ref")[0] + " as order_ref", _IMAGE.split(", ", 1)[1])


@register(
    "b2_session_orders",
    f"""{WALK}, newest as (select instrument_id, max(session_id) as session_id from starts group by instrument_id),
live as (select s.instrument_id, s.session_id, s.doc_at from sessions s join newest using (instrument_id, session_id) where doc_at is not null),
ev as (select f.instrument_id, f.arrival, f.event_id % 9 as order_ref, {FEED_ORDER} as kind, cast(f.event_id % 40 + 1 as decimal(18,2)) as qty
    from feed f join live using (instrument_id, session_id) where disposition in ('replayed', 'published')
  union all select v.instrument_id, cast(-1 as bigint), (event_id + i * 5) % 9, 'open', cast(10 * i + event_id % 10 as decimal(18,2))
    from v join live on v.instrument_id = live.instrument_id and v.arrival = live.doc_at, range(1, 4) r(i) where i <= event_id % 4),
a as (select *, max(case when kind in ('open', 'change', 'done') then arrival end) over (partition by instrument_id, order_ref) as last_abs from ev where kind <> 'received')
select instrument_id, order_ref, max(case when arrival = last_abs and kind <> 'match' then kind end) as last_kind,
  cast(max(case when arrival = last_abs and kind <> 'match' then qty end) - coalesce(sum(case when kind = 'match' and arrival > last_abs then qty end), 0) as decimal(18,2)) as resting_qty
from a where last_abs is not null group by instrument_id, order_ref having max(case when arrival = last_abs and kind <> 'match' then kind end) <> 'done'""",
)
def b2_session_orders(spark, sf_dir):
    """Resting orders of each instrument's newest session: its document's orders and what followed."""
    feed, events = _events(spark, sf_dir)
    named = session_feed(feed, events).where("disposition in ('replayed', 'published')").select(
        "instrument_id", "arrival", "session_id", (F.col("event_id") % 9).alias("order_ref"), F.expr(FEED_ORDER).alias("kind"),
        (F.col("event_id") % 40 + 1).cast("decimal(18,2)").alias("qty"),
    )
    return session_orders(named, images(spark, sf_dir), events)
