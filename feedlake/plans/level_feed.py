"""Queries over the price-level feed (V1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import ntz_nanos
from feedlake.operators import counters
from feedlake.operators.counters import count_if
from feedlake.operators.l2 import classify_l2, flatten_levels
from feedlake.operators.session_state import (
    apply_session_rules,
    boundary_counts,
    emit_resets,
    message_stream,
    message_transitions,
    trigger_log,
)
from feedlake.plans.oracle import L2_KINDS, L2_RULES
from feedlake.plans.registration import Family
from feedlake.plans.views import l2_frames, table
from feedlake.sources.capture import last_n
from feedlake.sources.frames import check_instruments, match_product
from feedlake.sources.metrics import counter_labels, to_prometheus

FAMILY = Family()
register = FAMILY.register


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_l2(l2_frames(spark, sf_dir))


def ruled(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """V1 after the session rules, with only the needed columns in the shuffle."""
    return apply_session_rules(classified(spark, sf_dir).select("instrument_id", "arrival", "kind", *extra))


@register(
    "flagship_session_counts",
    f"""with {L2_RULES}
select instrument_id, count(*) as frames,
  count(*) filter (where disposition = 'accepted_snapshot') as snapshots_accepted,
  count(*) filter (where disposition = 'duplicate_snapshot') as duplicate_snapshots,
  count(*) filter (where disposition = 'published') as updates,
  count(*) filter (where disposition = 'pre_snapshot') as pre_snapshot_drops,
  count(*) filter (where disposition = 'rejected') as malformed,
  count(*) filter (where disposition = 'mismatch') as product_mismatches,
  cast(sum(attempt) as bigint) as recovery_attempts,
  cast(sum(ignored) as bigint) as recovery_ignored
from r group by instrument_id""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, accepted snapshots, duplicates, updates, drops and recoveries per instrument."""
    done = F.col("disposition")
    return (
        ruled(spark, sf_dir)
        .groupBy("instrument_id")
        .agg(
            F.count("*").alias("frames"),
            count_if(done == "accepted_snapshot").alias("snapshots_accepted"),
            count_if(done == "duplicate_snapshot").alias("duplicate_snapshots"),
            count_if(done == "published").alias("updates"),
            count_if(done == "pre_snapshot").alias("pre_snapshot_drops"),
            count_if(done == "rejected").alias("malformed"),
            count_if(done == "mismatch").alias("product_mismatches"),
            count_if(F.col("attempt")).alias("recovery_attempts"),
            count_if(F.col("ignored")).alias("recovery_ignored"),
        )
    )


@register(
    "s1_frame_intake",
    f"""with {L2_KINDS}
select instrument_id, count(*) as frames, cast(sum(strlen(payload)) as bigint) as bytes,
  min(arrival) as first_arrival, max(arrival) as last_arrival from v group by instrument_id""",
)
def frame_intake(spark, sf_dir):
    return (
        l2_frames(spark, sf_dir)
        .groupBy("instrument_id")
        .agg(
            F.count("*").alias("frames"),
            F.sum(F.octet_length("payload")).alias("bytes"),
            F.min("arrival").alias("first_arrival"),
            F.max("arrival").alias("last_arrival"),
        )
    )


@register(
    "s5_last_five_frames",
    f"""with {L2_KINDS},
a as (select instrument_id, arrival, payload,
  row_number() over (partition by instrument_id order by arrival desc) as age,
  count(*) over (partition by instrument_id) as total from v)
select instrument_id, arrival, payload, age, total from a where age <= 5""",
)
def last_five(spark, sf_dir):
    return last_n(l2_frames(spark, sf_dir).select("instrument_id", "arrival", "payload"), 5)


_INSTRUMENTS = """select case when s_suppkey % 17 = 0 then '' else concat('S', cast(s_suppkey % 90 as TXT)) end as exchange_symbol,
  cast(s_suppkey % 80 - 2 as bigint) as instrument_id from supplier"""


@register(
    "s6_instrument_violations",
    f"""with d as ({_INSTRUMENTS.replace("TXT", "varchar")})
select 'blank_symbol' as rule, exchange_symbol, instrument_id, count(*) as occurrences from d
  where trim(exchange_symbol) = '' group by exchange_symbol, instrument_id
union all select 'id_not_positive', exchange_symbol, instrument_id, count(*) from d
  where instrument_id <= 0 group by exchange_symbol, instrument_id
union all select 'duplicate_symbol', exchange_symbol, null, count(*) from d
  where trim(exchange_symbol) <> '' group by exchange_symbol having count(*) > 1
union all select 'duplicate_id', null, instrument_id, count(*) from d group by instrument_id having count(*) > 1""",
)
def instrument_violations(spark, sf_dir):
    key = F.col("s_suppkey")
    return check_instruments(
        table(spark, sf_dir, "supplier").select(
            F.when(key % 17 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("S"), (key % 90).cast("string")))
            .alias("exchange_symbol"),
            (key % 80 - 2).cast("bigint").alias("instrument_id"),
        )
    )


@register(
    "p1_frame_kinds",
    f"""with {L2_KINDS} select instrument_id, arrival, t as frame_type, p as product_key, kind
from (select *, case when p = '' then null else p end as product_key from k) x""".replace(
        "p as product_key, kind", "product_key, kind"
    ),
)
def frame_kinds(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "instrument_id", "arrival", "frame_type", F.col("product_id").alias("product_key"), "kind"
    )


@register(
    "p3_product_match",
    f"""with {L2_KINDS}, dim as (select distinct user_id as instrument_id, concat('P', cast(user_id as varchar)) as symbol
  from events where user_id % 10 <> 3)
select f.instrument_id, f.arrival, dim.symbol, coalesce(f.p = dim.symbol, false) as product_match
from f left join dim on f.instrument_id = dim.instrument_id""",
)
def product_match(spark, sf_dir):
    """J1 as well: instruments missing from the dimension stay as unmatched rows."""
    dimension = (
        table(spark, sf_dir, "events")
        .where("user_id % 10 <> 3")
        .select(F.col("user_id").alias("instrument_id"))
        .distinct()
        .withColumn("exchange_symbol", F.concat(F.lit("P"), F.col("instrument_id").cast("string")))
    )
    frames = l2_frames(spark, sf_dir).drop("symbol").withColumn(
        "product_id", F.regexp_extract("payload", '"product_id":"([^"]*)"', 1)
    )
    return match_product(frames, dimension).select("instrument_id", "arrival", "symbol", "product_match")


@register(
    "j1_unmatched_symbols",
    """with f as (select user_id, event_id from events), dim as (select distinct user_id as u from events where user_id % 10 <> 3)
select user_id as instrument_id, count(*) as dropped from f where user_id not in (select u from dim) group by user_id""",
)
def unmatched_symbols(spark, sf_dir):
    """Dropped and counted: frames are counted per instrument before the anti join, so it stays small."""
    events = table(spark, sf_dir, "events")
    known = events.where("user_id % 10 <> 3").select(F.col("user_id").alias("instrument_id")).distinct()
    counted = events.groupBy(F.col("user_id").alias("instrument_id")).agg(F.count("*").alias("dropped"))
    return counted.join(known, "instrument_id", "left_anti")


@register(
    "p4_quarantine",
    f"with {L2_RULES} select instrument_id, arrival, disposition, payload from r where disposition in ('rejected', 'mismatch')",
)
def quarantine(spark, sf_dir):
    bad = ruled(spark, sf_dir, "payload").where(F.col("disposition").isin("rejected", "mismatch", "malformed"))
    return bad.select("instrument_id", "arrival", "disposition", "payload")


def _levels(spark, sf_dir, kind):
    good = classified(spark, sf_dir).where(F.col("kind") == kind)
    return flatten_levels(good, "instrument_id", "arrival", "exchange_ns")


_CENTS = "cast(cast({} as decimal(18,2)) * 100 as bigint)"


@register(
    "p5_snapshot_levels",
    f"""with {L2_KINDS}, s as (select instrument_id, arrival, value from k join events e using (event_id) where kind = 'snapshot')
select instrument_id, arrival, cast(-1 as bigint) as exchange_ns, 0 as entry_pos, 1 as side, 1 as action,
  {_CENTS.format("value")} as price_m, 2 as price_s, cast(150 as bigint) as qty_m, 2 as qty_s from s
union all select instrument_id, arrival, -1, 1, 2, 1, {_CENTS.format("value + 1")}, 2, 200, 2 from s""",
)
def snapshot_rows(spark, sf_dir):
    return _levels(spark, sf_dir, "snapshot")


@register(
    "p6_update_levels",
    f"""with {L2_KINDS}, s as (select instrument_id, arrival, event_id, event_type, value from k join events e using (event_id) where kind = 'update')
select instrument_id, arrival, cast(-1 as bigint) as exchange_ns, 0 as entry_pos,
  case when event_type = 'click' then 1 else 2 end as side,
  case when event_type = 'click' and event_id % 5 = 0 then 2 else 1 end as action,
  {_CENTS.format("value")} as price_m, 2 as price_s,
  cast(case when event_type <> 'click' then 100 when event_id % 5 = 0 then 0 else 325 end as bigint) as qty_m,
  case when event_type = 'click' and event_id % 5 = 0 then 0 else 2 end as qty_s from s""",
)
def update_rows(spark, sf_dir):
    return _levels(spark, sf_dir, "update")


@register(
    "p14_heartbeats",
    f"""with {L2_KINDS} select instrument_id, count(*) as heartbeats, max(epoch_us(ts)) * 1000 as last_heartbeat_ns
from k where kind = 'heartbeat' group by instrument_id""",
)
def heartbeats(spark, sf_dir):
    beats = classified(spark, sf_dir).where("kind = 'heartbeat'")
    return beats.groupBy("instrument_id").agg(
        F.count("*").alias("heartbeats"), F.max(ntz_nanos(F.col("ts"))).alias("last_heartbeat_ns")
    )


@register(
    "p15_acknowledgements",
    f"with {L2_KINDS} select instrument_id, arrival, kind = 'ack' as valid from k where kind in ('ack', 'trigger')",
)
def acknowledgements(spark, sf_dir):
    acks = classified(spark, sf_dir).where("frame_type = 'subscriptions'")
    return acks.select("instrument_id", "arrival", (F.col("kind") == "ack").alias("valid"))


@register(
    "p17_entry_cap",
    f"""with {L2_KINDS} select instrument_id, count(*) filter (where kind = 'snapshot') as over_cap,
  count(*) filter (where kind = 'update') as within_cap from k group by instrument_id""",
)
def entry_cap(spark, sf_dir):
    """With the cap lowered to one entry every two-level snapshot is refused, every update passes."""
    capped = classify_l2(l2_frames(spark, sf_dir), max_entries=1)
    return capped.groupBy("instrument_id").agg(
        count_if(F.col("over_cap")).alias("over_cap"), count_if(F.col("kind") == "update").alias("within_cap")
    )


@register(
    "w1_snapshot_gate",
    f"with {L2_RULES} select instrument_id, arrival, kind, open_before = 1 as open_before, open_after = 1 as open_after, disposition from r",
)
def snapshot_gate(spark, sf_dir):
    return ruled(spark, sf_dir).select(
        "instrument_id", "arrival", "kind", "open_before", "open_after", "disposition"
    )


@register(
    "w2_w5_session_sequence",
    f"with {L2_RULES} select instrument_id, arrival, session_id, gateway_seq from r where pub = 1 or attempt = 1",
)
def session_sequence(spark, sf_dir):
    rows = ruled(spark, sf_dir).where("publishable or attempt")
    return rows.select("instrument_id", "arrival", "session_id", "gateway_seq")


@register(
    "w3_w4_trigger_log",
    f"""with {L2_RULES} select instrument_id, arrival, 'RESET' as request_type,
  case when kind = 'trigger' then 'STREAM_INTEGRITY_FAILURE' else 'OUT_OF_ORDER_OR_INVALID_TRANSITION' end as reason_code,
  case when kind = 'trigger' then 'trigger' else 'duplicate snapshot' end as text,
  case when attempt = 1 then 'applied' else 'ignored' end as outcome from r where trg_pos is not null""",
)
def triggers(spark, sf_dir):
    return trigger_log(ruled(spark, sf_dir), "instrument_id", "arrival")


@register(
    "s8_reset_messages",
    f"""with {L2_RULES} select instrument_id, arrival, session_id, 1 as event_type, cast(0 as bigint) as gateway_seq,
  cast(0 as bigint) as seq1, cast(0 as bigint) as seq2, cast(-1 as bigint) as exchange_ns, 0 as entry_count from r where attempt = 1""",
)
def resets(spark, sf_dir):
    return emit_resets(ruled(spark, sf_dir), "instrument_id", "arrival")


@register(
    "w10_message_transitions",
    f"""with {L2_RULES}, m as (select instrument_id, arrival, session_id,
    case when attempt = 1 then 1 when acc_pos is not null then 2 else 3 end as event_type from r where attempt = 1 or pub = 1),
p as (select *, coalesce(lag(event_type) over (partition by instrument_id, session_id order by arrival), 0) as prev_event from m)
select prev_event, event_type, count(*) as messages from p group by prev_event, event_type""",
)
def transitions(spark, sf_dir):
    """Only 0-1, 0-2, 1-2, 2-3 and 3-3 may appear; the reset opens its session."""
    rows = ruled(spark, sf_dir, "exchange_ns", "entry_count")
    traced = message_transitions(message_stream(rows, "instrument_id", "arrival"))
    return traced.groupBy("prev_event", "event_type").agg(F.count("*").alias("messages"))


@register(
    "w11_boundaries_per_session",
    f"""with {L2_RULES}, s as (select instrument_id, session_id, count(acc_pos) as boundaries from r group by instrument_id, session_id)
select boundaries, count(*) as sessions from s group by boundaries""",
)
def boundaries(spark, sf_dir):
    counts = boundary_counts(ruled(spark, sf_dir), "instrument_id")
    return counts.groupBy("boundaries").agg(F.count("*").alias("sessions"))


A1_SQL = """count(*) as frames_received, cast(sum(strlen(payload)) as bigint) as bytes_received,
  count(*) filter (where disposition in ('accepted_snapshot','published','heartbeat','ack')) as messages_decoded,
  count(*) filter (where disposition = 'accepted_snapshot') as snapshot_messages_received,
  count(*) filter (where disposition = 'published') as update_messages_received,
  count(*) filter (where disposition = 'heartbeat') as heartbeats_received,
  count(*) filter (where disposition = 'rejected') as parse_failures,
  count(*) filter (where disposition = 'rejected') as malformed_rejections,
  cast(0 as bigint) as authentication_errors, cast(0 as bigint) as unknown_type_drops,
  count(*) filter (where disposition = 'pre_snapshot') as pre_snapshot_drops,
  count(*) filter (where disposition = 'mismatch') as unknown_symbol_drops,
  count(*) filter (where disposition = 'mismatch') as product_id_mismatches,
  count(*) filter (where disposition = 'trigger') as subscription_validation_failures"""

A2_SQL = """cast(sum(pub) as bigint) as encode_successes, cast(0 as bigint) as encode_failures,
  cast(sum(case when acc_pos is not null then 2 when pub = 1 then 1 else 0 end) as bigint) as levels_encoded,
  cast(sum(case when acc_pos is not null then 99 when pub = 1 then 79 else 0 end) as bigint) as encoded_bytes"""
A3_SQL = """cast(sum(attempt) as bigint) as recovery_attempts, cast(sum(attempt) as bigint) as recovery_executions,
  count(*) filter (where acc_pos is not null and pt > pa) as recovery_completions,
  cast(0 as bigint) as recovery_failures, cast(sum(ignored) as bigint) as recovery_requests_ignored_in_progress"""
A7_SQL = f"""with {L2_RULES} select instrument_id, disposition as error, count(*) as occurrences,
  min(epoch_us(ts)) * 1000 as first_seen, max(epoch_us(ts)) * 1000 as last_seen
from r where disposition in ('rejected', 'mismatch', 'trigger', 'duplicate_snapshot') group by instrument_id, disposition"""


def _accounted(spark, sf_dir):
    frames = l2_frames(spark, sf_dir).withColumn("frame_bytes", F.octet_length("payload"))
    return apply_session_rules(
        classify_l2(frames).select("instrument_id", "arrival", "kind", "over_cap", "entry_count", "frame_bytes")
    )


@register("a1_frame_accounting", f"with {L2_RULES} select instrument_id, {A1_SQL} from r group by instrument_id")
def frame_accounting(spark, sf_dir):
    return counters.aggregate(_accounted(spark, sf_dir), counters.frame_accounting(), "instrument_id")


@register(
    "a2_encode_accounting",
    f"with {L2_RULES} select instrument_id, {A2_SQL} from r group by instrument_id",
)
def encode_accounting(spark, sf_dir):
    return counters.aggregate(_accounted(spark, sf_dir), counters.encode_accounting(F.lit(1)), "instrument_id")


@register(
    "a3_recovery_accounting",
    f"with {L2_RULES} select instrument_id, {A3_SQL} from r group by instrument_id",
)
def recovery_accounting(spark, sf_dir):
    return counters.aggregate(ruled(spark, sf_dir), counters.recovery_accounting(), "instrument_id")


@register(
    "a4_last_seen",
    f"""with {L2_KINDS} select instrument_id, max(epoch_us(ts)) * 1000 as last_message_received_nanos,
  max(case when kind in ('heartbeat', 'ack') then epoch_us(ts) end) * 1000 as last_heartbeat_received_nanos from k group by instrument_id""",
)
def last_seen(spark, sf_dir):
    """A valid acknowledgement seeds the heartbeat clock."""
    at = ntz_nanos(F.col("ts"))
    return (
        classified(spark, sf_dir)
        .groupBy("instrument_id")
        .agg(
            F.max(at).alias("last_message_received_nanos"),
            F.max(F.when(F.col("kind").isin("heartbeat", "ack"), at)).alias("last_heartbeat_received_nanos"),
        )
    )


@register("a7_error_groups", A7_SQL)
def error_groups(spark, sf_dir):
    rows = ruled(spark, sf_dir, "ts").where(
        F.col("disposition").isin("rejected", "mismatch", "trigger", "duplicate_snapshot")
    )
    timed = rows.select("instrument_id", F.col("disposition").alias("error"), ntz_nanos(F.col("ts")).alias("ts"))
    return counters.error_groups(timed, "instrument_id", "error")


@register(
    "s7_metric_lines",
    f"""with {L2_RULES}, a as (select instrument_id, {A1_SQL} from r group by instrument_id),
u as (unpivot a on columns(* exclude (instrument_id)) into name name value value)
select concat('gateway_', name, '{{instance_id="i-1",environment="test",venue="L2",instrument_id="', cast(instrument_id as varchar), '"}} ', cast(value as varchar)) as line from u""",
)
def metric_lines(spark, sf_dir):
    wide = counters.aggregate(_accounted(spark, sf_dir), counters.frame_accounting(), "instrument_id")
    return to_prometheus(counter_labels(wide, "i-1", "test", "L2"))
