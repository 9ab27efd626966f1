"""Per-instrument session rules as bucketed folds: gate, recovery coalescing, session, sequence.

Gate: ``snapshot`` opens a closed gate; on an open gate any snapshot is a duplicate, which closes it
and asks for recovery. Every kind in ``TRIGGERS`` closes it. ``bad_snapshot`` acts on the gate like a trigger.
After a closing row the state is known without looking back, and between closing rows the gate is
the parity of the snapshots seen. A bucket therefore needs only one bit from the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.ordering import BUCKET, Lane, max_before, running

LANE = Lane()
# Kinds that close the gate and ask for recovery, with their reason code.
TRIGGERS = {
    "trigger": "STREAM_INTEGRITY_FAILURE",
    "error": "STREAM_INTEGRITY_FAILURE",
    "gap": "STREAM_INTEGRITY_FAILURE",
    "overflow": "STREAM_INTEGRITY_FAILURE",
    "disconnect": "STREAM_INTEGRITY_FAILURE",
    "timeout": "HEARTBEAT_TIMEOUT",
    "request": "MANUAL_RESET",
}


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def gate(classified: DataFrame, lane: Lane = LANE) -> DataFrame:
    """Add ``open_before``, ``open_after`` and ``seen_before`` (any snapshot or trigger earlier)."""
    kind = F.col("kind")
    opens, closes = _flag(kind == "snapshot"), _flag(kind.isin(*TRIGGERS, "bad_snapshot"))
    rows = (
        lane.bucketed(classified)
        .withColumn("_opens", F.sum(opens).over(lane.upto()))
        .withColumn("_mark", F.max(F.when(closes == 1, F.col("_opens"))).over(lane.upto()))
        .withColumn("_known", F.col("_mark").isNotNull())
        .withColumn("_parity", (F.col("_opens") - F.coalesce("_mark", F.lit(0))) % 2)
        .withColumn("_seen", F.max(_flag(kind.isin("snapshot", *TRIGGERS))).over(lane.upto()))
    )
    ends = rows.groupBy(*lane.part).agg(
        F.max_by(F.struct("_parity", "_known"), lane.pos).alias("end"), F.max("_seen").alias("any_seen")
    )
    starts = _gate_starts(ends, lane)
    first = F.col("_start_open")
    combine = lambda parity, known: F.when(known, parity).otherwise((parity + first) % 2) == 1
    inside = lane.inside()
    done = (
        rows.withColumn("_prev_parity", F.lag("_parity", 1, 0).over(inside))
        .withColumn("_prev_known", F.lag("_known", 1, False).over(inside))
        .withColumn("_prev_seen", F.lag("_seen", 1, 0).over(inside))
        .join(starts, lane.part)
        .withColumn("open_after", combine(F.col("_parity"), F.col("_known")))
        .withColumn("open_before", combine(F.col("_prev_parity"), F.col("_prev_known")))
        .withColumn("seen_before", F.greatest("_prev_seen", "_start_seen") == 1)
        .drop(
            "_opens", "_mark", "_known", "_parity", "_seen", "_prev_parity", "_prev_known", "_prev_seen",
            "_start_open", "_start_seen",
        )
    )
    return lane.released(done, classified)


def _gate_starts(ends: DataFrame, lane: Lane, *keep: str) -> DataFrame:
    """State at the start of each bucket from the end-of-bucket parities."""
    w = lane.across()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    parity, known = F.col("end._parity"), F.col("end._known")
    return (
        ends.withColumn("_sum", F.sum(parity).over(upto))
        .withColumn("_base", F.max(F.when(known, F.col("_sum") - parity)).over(upto))
        .withColumn("_out", (F.col("_sum") - F.coalesce("_base", F.lit(0))) % 2)
        .select(
            *lane.part,
            *keep,
            F.coalesce(F.lag("_out").over(w), F.lit(0)).alias("_start_open"),
            F.coalesce(F.max("any_seen").over(earlier), F.lit(0)).alias("_start_seen"),
        )
    )


def coalesce_recovery(gated: DataFrame, lane: Lane = LANE, failures: bool = False) -> DataFrame:
    """Add ``is_trigger``, ``attempt``, ``ignored`` and ``recovering`` (a recovery is open before the row).

    A trigger while a recovery is open is ignored. Once the gate has closed for any reason other
    than the start of the stream, a recovery is open until the next accepted snapshot; with
    ``failures`` a ``recovery_failed`` row ends it as well.
    """
    kind, was_open = F.col("kind"), F.col("open_before")
    flagged = gated.withColumn(
        "is_trigger", kind.isin(*TRIGGERS) | (kind.isin("snapshot", "bad_snapshot") & was_open)
    )
    if failures:
        pos = F.col(lane.pos)
        flagged = running(
            flagged,
            lane,
            _last_trigger=max_before(F.when(F.col("is_trigger"), pos)),
            _last_failure=max_before(F.when(kind == "recovery_failed", pos)),
        )
        in_progress = ~was_open & F.coalesce(
            F.col("_last_trigger") > F.coalesce("_last_failure", F.lit(-1)), F.lit(False)
        )
    else:
        in_progress = ~was_open & F.col("seen_before")
    return (
        flagged.withColumn("attempt", F.col("is_trigger") & ~in_progress)
        .withColumn("ignored", F.col("is_trigger") & in_progress)
        .withColumn("recovering", in_progress)
        .drop("_last_trigger", "_last_failure")
    )


def disposition(gated: DataFrame) -> DataFrame:
    """Add ``disposition``, the one outcome of each frame, and ``publishable``."""
    kind, was_open = F.col("kind"), F.col("open_before")
    outcome = (
        F.when(kind.isin("snapshot", "bad_snapshot") & was_open, "duplicate_snapshot")
        .when(kind == "snapshot", "accepted_snapshot")
        .when(kind == "bad_snapshot", "rejected")
        .when(kind.isin("update", "trade", "bad_update") & ~was_open, "pre_snapshot")
        .when(kind == "bad_update", "rejected")
        .when(kind.isin("update", "trade"), "published")
        .otherwise(kind)
    )
    done = gated.withColumn("disposition", outcome)
    return done.withColumn("publishable", F.col("disposition").isin("accepted_snapshot", "published"))


def sequence(rows: DataFrame, lane: Lane = LANE) -> DataFrame:
    """Add ``session_id`` and ``gateway_seq``.

    The session counts applied resets. The gateway sequence counts publishable messages of the
    session from 1; the reset itself carries 0 and consumes none.
    """
    attempt, publish = _flag(F.col("attempt")), _flag(F.col("publishable"))
    local = (
        lane.bucketed(rows)
        .withColumn("_session", F.sum(attempt).over(lane.upto()))
        .withColumn("_count", F.sum(publish).over(lane.upto()))
        .withColumn("_mark", F.max(F.when(attempt == 1, F.col("_count"))).over(lane.upto()))
    )
    ends = local.groupBy(*lane.part).agg(
        F.max("_session").alias("sessions"), F.max("_count").alias("published"), F.max("_mark").alias("mark")
    )
    w = lane.across()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ends.withColumn("_prior", F.coalesce(F.sum("published").over(earlier), F.lit(0)))
        .withColumn("_base", F.max(F.col("_prior") + F.col("mark")).over(earlier))
        .select(
            *lane.part,
            F.coalesce(F.sum("sessions").over(earlier), F.lit(0)).alias("_start_session"),
            (F.col("_prior") - F.coalesce("_base", F.lit(0))).alias("_start_seq"),
        )
    )
    in_session = F.when(F.col("_mark").isNotNull(), F.col("_count") - F.col("_mark")).otherwise(
        F.col("_count") + F.col("_start_seq")
    )
    done = (
        local.join(starts, lane.part)
        .withColumn("session_id", F.col("_session") + F.col("_start_session"))
        .withColumn("gateway_seq", F.when(F.col("publishable"), in_session))
        .drop("_session", "_count", "_mark", "_start_session", "_start_seq")
    )
    return lane.released(done, rows)


def apply_session_rules(classified: DataFrame, lane: Lane = LANE, failures: bool = False) -> DataFrame:
    """Gate, coalescing, disposition, session and sequence in one go.

    Without failed recoveries all of it needs one pass over the rows: see :func:`_rules_in_one_pass`.
    """
    placed = lane.bucketed(classified)
    if failures:
        ruled = sequence(disposition(coalesce_recovery(gate(placed, lane), lane, failures=True)), lane)
    else:
        ruled = _rules_in_one_pass(placed, lane)
    return ruled.drop(BUCKET)


def _rules_in_one_pass(placed: DataFrame, lane: Lane) -> DataFrame:
    """All session rules with a single summary join.

    A bucket starts in one of three states: gate closed and nothing seen yet (``new``), closed with a
    recovery open (``rec``), or open (``live``). The counts inside a bucket are taken for each of
    them; the fold over the bucket summaries then says which one holds, and the row picks its own.
    """
    kind, upto, inside = F.col("kind"), lane.upto(), lane.inside()
    snapshot, update = kind == "snapshot", kind.isin("update", "trade")
    invalid, trigger = kind.isin("snapshot", "bad_snapshot"), kind.isin(*TRIGGERS)
    closes = kind.isin(*TRIGGERS, "bad_snapshot")
    rows = placed.withColumns(
        {
            "_opens": F.sum(_flag(snapshot)).over(upto),
            "_seen": F.max(_flag(snapshot | trigger)).over(upto),
        }
    ).withColumn("_mark", F.max(F.when(closes, F.col("_opens"))).over(upto))
    rows = rows.withColumns(
        {"_known": F.col("_mark").isNotNull(), "_parity": (F.col("_opens") - F.coalesce("_mark", F.lit(0))) % 2}
    ).withColumns(
        {
            "_prev_parity": F.lag("_parity", 1, 0).over(inside),
            "_prev_known": F.lag("_known", 1, False).over(inside),
            "_prev_seen": F.lag("_seen", 1, 0).over(inside) == 1,
        }
    )
    # Gate before the row, for a bucket that starts closed or open.
    shut = F.col("_prev_parity") == 1
    live = F.when(F.col("_prev_known"), shut).otherwise(~shut)
    asks = {"new": trigger | (invalid & shut), "live": trigger | (invalid & live)}
    attempts = {
        "new": asks["new"] & (shut | ~F.col("_prev_seen")),
        "rec": asks["new"] & shut,
        "live": asks["live"] & live,
    }
    sent = {"shut": (snapshot & ~shut) | (update & shut), "live": (snapshot & ~live) | (update & live)}
    rows = rows.withColumns(
        {
            **{f"_session_{e}": F.sum(_flag(a)).over(upto) for e, a in attempts.items()},
            **{f"_count_{g}": F.sum(_flag(p)).over(upto) for g, p in sent.items()},
        }
    ).withColumns(
        {
            f"_base_{e}": F.max(F.when(a, F.col("_count_live" if e == "live" else "_count_shut"))).over(upto)
            for e, a in attempts.items()
        }
    )
    counted = [c for c in rows.columns if c.startswith(("_session_", "_count_", "_base_"))]
    ends = rows.groupBy(*lane.part).agg(
        F.max_by(F.struct("_parity", "_known"), lane.pos).alias("end"),
        F.max("_seen").alias("any_seen"),
        *[F.max(c).alias(c) for c in counted],
    )
    joined = rows.join(_starts_in_one_pass(ends, lane), lane.part)
    is_live, pick = F.col("_start_open") == 1, _picker()
    was_open = F.when(is_live, live).otherwise(shut)
    attempt = F.when(is_live, attempts["live"]).when(F.col("_start_seen") == 1, attempts["rec"]).otherwise(attempts["new"])
    wants = F.when(is_live, asks["live"]).otherwise(asks["new"])
    after = F.when(F.col("_known"), F.col("_parity")).otherwise((F.col("_parity") + F.col("_start_open")) % 2) == 1
    base, count = pick("_base"), F.when(is_live, F.col("_count_live")).otherwise(F.col("_count_shut"))
    ruled = joined.withColumns(
        {
            "open_before": was_open,
            "open_after": after,
            "seen_before": F.col("_prev_seen") | (F.col("_start_seen") == 1),
            "is_trigger": wants,
            "attempt": attempt,
            "ignored": wants & ~attempt,
            "recovering": ~was_open & (F.col("_prev_seen") | (F.col("_start_seen") == 1)),
            "session_id": pick("_session") + F.col("_start_session"),
            "_seq": F.when(base.isNotNull(), count - base).otherwise(count + F.col("_start_seq")),
        }
    )
    done = disposition(ruled).withColumn("gateway_seq", F.when(F.col("publishable"), F.col("_seq")))
    return done.drop(*[c for c in done.columns if c.startswith("_") and c != BUCKET and c not in placed.columns])


def _picker():
    """Choose the variant of a counted column by the state at the start of the bucket."""

    def pick(name: str) -> Column:
        return (
            F.when(F.col("_start_open") == 1, F.col(f"{name}_live"))
            .when(F.col("_start_seen") == 1, F.col(f"{name}_rec"))
            .otherwise(F.col(f"{name}_new"))
        )

    return pick


def _starts_in_one_pass(ends: DataFrame, lane: Lane) -> DataFrame:
    """State, session and sequence at the start of each bucket."""
    carried = [c for c in ends.columns if c.startswith(("_session_", "_count_", "_base_"))]
    known = _gate_starts(ends, lane, *carried)
    pick = _picker()
    published = F.when(F.col("_start_open") == 1, F.col("_count_live")).otherwise(F.col("_count_shut"))
    earlier = lane.across().rowsBetween(Window.unboundedPreceding, -1)
    prior = known.withColumns(
        {"_prior": F.coalesce(F.sum(published).over(earlier), F.lit(0)), "_mark_here": pick("_base")}
    )
    based = prior.withColumn("_base", F.max(F.col("_prior") + F.col("_mark_here")).over(earlier))
    return based.select(
        *lane.part,
        "_start_open",
        "_start_seen",
        F.coalesce(F.sum(pick("_session")).over(earlier), F.lit(0)).alias("_start_session"),
        (F.col("_prior") - F.coalesce("_base", F.lit(0))).alias("_start_seq"),
    )


def emit_resets(rows: DataFrame, *keep: str) -> DataFrame:
    """One zero-entry reset message per applied recovery: sequences 0, no exchange time."""
    zero = F.lit(0).cast("bigint")
    return rows.where("attempt").select(
        *keep,
        "session_id",
        F.lit(1).alias("event_type"),
        zero.alias("gateway_seq"),
        zero.alias("seq1"),
        zero.alias("seq2"),
        F.lit(-1).cast("bigint").alias("exchange_ns"),
        F.lit(0).alias("entry_count"),
    )


def emit_messages(rows: DataFrame, *keep: str) -> DataFrame:
    """Publishable rows as messages; ``seq1``/``seq2`` are the gateway sequence unless the feed has its own."""
    own = F.col("exchange_seq") if "exchange_seq" in rows.columns else F.col("gateway_seq")
    event = (
        F.when(F.col("disposition") == "accepted_snapshot", 2).when(F.col("kind") == "trade", 4).otherwise(3)
    )
    return rows.where("publishable").select(
        *keep,
        "session_id",
        event.alias("event_type"),
        "gateway_seq",
        own.alias("seq1"),
        own.alias("seq2"),
        "exchange_ns",
        "entry_count",
    )


def message_stream(rows: DataFrame, *keep: str) -> DataFrame:
    """Resets, snapshots, updates and trades as one message table."""
    return emit_resets(rows, *keep).unionByName(emit_messages(rows, *keep))


def message_transitions(messages: DataFrame, lane: Lane = LANE) -> DataFrame:
    """Add ``prev_event``, the event type before each message of the same session (0 = none)."""
    traced = running(messages, lane, _last=max_before(F.struct(F.col(lane.pos), "session_id", "event_type")))
    same = F.col("_last.session_id") == F.col("session_id")
    return traced.withColumn("prev_event", F.coalesce(F.when(same, F.col("_last.event_type")), F.lit(0))).drop("_last")


def order_violations(messages: DataFrame, lane: Lane = LANE) -> DataFrame:
    """Messages that break reset, snapshot, update order within a session."""
    prev, event = F.col("prev_event"), F.col("event_type")
    fine = (
        (prev.isin(0) & event.isin(1, 2))
        | ((prev == 1) & (event == 2))
        | (prev.isin(2, 3, 4) & event.isin(3, 4))
    )
    return message_transitions(messages, lane).where(~fine)


def boundary_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Accepted snapshots per session; more than one breaks the one-shot boundary rule."""
    accepted = F.col("disposition") == "accepted_snapshot"
    return rows.groupBy(*keys, "session_id").agg(F.count_if(accepted).alias("boundaries"))


def trigger_log(rows: DataFrame, *keep: str) -> DataFrame:
    """Every trigger with its reason code, its text and whether it was applied."""
    kind = F.col("kind")
    invalid = kind.isin("snapshot", "bad_snapshot")
    reason = F.when(invalid, "OUT_OF_ORDER_OR_INVALID_TRANSITION")
    for name, code in TRIGGERS.items():
        reason = reason.when(kind == name, code)
    return rows.where("is_trigger").select(
        *keep,
        F.lit("RESET").alias("request_type"),
        reason.alias("reason_code"),
        F.when(invalid, F.lit("duplicate snapshot")).otherwise(kind).alias("text"),
        F.when(F.col("attempt"), F.lit("applied")).otherwise(F.lit("ignored")).alias("outcome"),
    )
