"""One feed, all recovery triggers: gate, alignment, overflow, liveness and coalescing folded together.

The rules depend on each other. A hole in the buffered deltas asks for recovery; an applied recovery opens a
new session, empties the buffer and restarts the liveness clock; the next document is judged against the
deltas since that reset; a timeout is one more trigger. So they are one machine (:class:`FeedRules`), run over
arrival buckets in parallel by :func:`feedlake.operators.bucketfold.fold_buckets`.

Kinds of rows: ``update`` and ``trade`` (deltas, with ``seq``), ``snapshot`` (``seq`` is its boundary) and
``bad_snapshot`` (a refused document), ``ack`` and ``heartbeat`` (signals), ``recovery_failed``, and the triggers
``trigger``, ``error``, ``gap``, ``overflow``, ``request``, ``disconnect`` and ``timeout``. Other kinds only tell the time.
``at_ns`` does not decrease within a key; a null time takes no part in liveness.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.align import BUFFER_SLOTS
from feedlake.operators.bucketfold import State, fold_buckets
from feedlake.operators.ordering import BUCKET, Lane, max_before, running, sum_upto
from feedlake.operators.session_state import TRIGGERS

LANE = Lane()
DELTAS = ("update", "trade")
SIGNALS = ("ack", "heartbeat")
#: Reason codes of the triggers that are no row of their own.
REASONS = {**TRIGGERS, "duplicate": "OUT_OF_ORDER_OR_INVALID_TRANSITION", "refused": "STREAM_INTEGRITY_FAILURE"}


def replayed_range(ring: list[list[int]], boundary: int) -> tuple[int | None, int | None]:
    """Positions of the first delta above the boundary and of the first one that breaks the order (or None)."""
    live = None
    expected = boundary + 1
    for pos, seq, *_ in ring:
        if live is None and seq <= boundary:
            continue
        live = pos if live is None else live
        if seq != expected:
            return live, pos
        expected = seq + 1
    return live, None


class FeedRules:
    """Session rules of one instrument.

    ``buffered`` is the order feed: while no document has been accepted, deltas wait in a buffer of ``slots`` slots
    (one stays free) and are aligned to the document that ends the wait; documents at other times are
    ignored. Otherwise it is the level feed: a snapshot opens the gate, a second one is a ``duplicate``
    trigger. ``restart`` says whether monitoring starts with any signal and goes on after a recovery.
    A request while a recovery is open is ignored; a disconnect then is not even asked. A
    hole found at a document of a recovery leaves the gate open and the recovery too.
    """

    columns = ("kind", "at_ns", "seq")
    event = "event string, cause string, applied boolean, at_ns bigint, since_ns bigint, boundary bigint, live_from bigint, gap_at bigint"

    def __init__(self, buffered: bool, timeout: int | None = None, restart: bool = False, slots: int = BUFFER_SLOTS):
        self.buffered, self.timeout, self.restart, self.slots = buffered, timeout, restart, slots

    def initial(self) -> dict:
        return {"open": False, "recovering": False, "buffering": self.buffered, "ring": [], "watching": False, "start": None, "last": None}

    def step(self, s: State, pos: int, row: tuple) -> list[tuple]:
        kind, at, seq = row
        out: list[tuple] = []
        if self.timeout is not None and at is not None:
            self._watch(s, pos, at, out)
        if kind in DELTAS:
            if self.buffered and s.get("buffering"):
                ring = s.get("ring")
                if len(ring) >= self.slots - 1:
                    self._shut(s)
                    self._ask(s, pos, at, "overflow", out)
                else:
                    ring.append([pos, seq, kind == "trade"])
                    s.set("ring", ring)
        elif kind in SIGNALS:
            s.set("last", at)
            if not s.get("watching") and (kind == "ack" or self.restart):
                s.set("watching", True)
                s.set("start", at)
        elif kind in ("snapshot", "bad_snapshot"):
            self._document(s, pos, at, seq, kind == "snapshot", out)
        elif kind == "recovery_failed":
            s.set("recovering", False)
        elif kind in TRIGGERS:
            if not self._ask(s, pos, at, kind, out) and kind == "disconnect":
                self._monitor_again(s, at)
        return out

    def _document(self, s: State, pos: int, at: int, boundary: int, good: bool, out: list) -> None:
        if not self.buffered:
            if s.get("open"):
                self._ask(s, pos, at, "duplicate", out)
            elif good:
                s.set("open", True)
                s.set("recovering", False)
                out.append((pos, s.sessions, "snapshot", None, None, at, None, boundary, None, None))
            return
        if not s.get("buffering"):
            out.append((pos, s.sessions, "ignored_snapshot", None, None, at, None, boundary, None, None))
            return
        ring = s.get("ring")
        self._shut(s)
        if not good:
            self._ask(s, pos, at, "refused", out)
            return
        live, gap = replayed_range(ring, boundary)
        s.set("open", True)
        out.append((pos, s.sessions, "snapshot", None, None, at, None, boundary, live, gap))
        if gap is None:
            s.set("recovering", False)
        else:
            self._ask(s, pos, at, "gap", out)

    @staticmethod
    def _shut(s: State) -> None:
        s.set("buffering", False)
        s.set("ring", [])

    def _ask(self, s: State, pos: int, at: int, cause: str, out: list, since: int | None = None) -> bool:
        """Ask for recovery; True if it is applied: gate closed, new session, empty buffer."""
        applied = not s.get("recovering")
        if applied:
            s.sessions += 1
            s.set("recovering", True)
            s.set("open", False)
            s.set("buffering", self.buffered)
            s.set("ring", [])
            self._monitor_again(s, at)
        if applied or cause != "disconnect":
            out.append((pos, s.sessions, "trigger", cause, applied, at, since, None, None, None))
        return applied

    def _monitor_again(self, s: State, at: int) -> None:
        if self.timeout is None:
            return
        if not self.restart:
            s.set("watching", False)
        elif s.get("watching"):
            s.set("start", at)

    def _watch(self, s: State, pos: int, at: int, out: list) -> None:
        """Fire the checks before ``at``: a timeout after the start, then every half timeout. They take effect
        between the row before and this one."""
        half = self.timeout // 2
        while s.get("watching") and (last := s.get("last")) is not None and at - last > self.timeout:
            start = s.get("start")
            if start is None:  # only in a guess
                break
            check = start + self.timeout + max(0, -(-(last - start) // half)) * half
            if check >= at:
                break
            s.set("last", check)
            self._ask(s, pos - 1, check, "timeout", out, since=last)


def _guesses(rows: DataFrame, rules: FeedRules, lane: Lane) -> DataFrame:
    """A first guess per bucket: an open gate, and the last signal before it."""
    signal = F.when(F.col("kind").isin(*SIGNALS), F.struct(F.col(lane.pos), "at_ns"))
    ends = lane.bucketed(rows).groupBy(*lane.part).agg(F.max(signal).alias("_last"))
    earlier = lane.across().rowsBetween(Window.unboundedPreceding, -1)
    known = ends.withColumn("last", F.max("_last").over(earlier)["at_ns"])
    state = rules.initial() | {"open": True, "buffering": False, "watching": True}
    fields = [F.col("last") if name == "last" else F.from_json(F.lit(json.dumps({name: value})), f"{name} {_TYPES[name]}")[name] for name, value in state.items()]
    entry = F.to_json(F.struct(*[f.alias(n) for f, n in zip(fields, state, strict=True)]), {"ignoreNullFields": "false"})
    return known.select(*lane.part, entry.alias("entry"))


_TYPES = {
    "open": "boolean", "recovering": "boolean", "buffering": "boolean", "ring": "array<string>",
    "watching": "boolean", "start": "bigint", "last": "bigint",
}


def feed_events(frames: DataFrame, rules: FeedRules, lane: Lane = LANE, horizon_ns: int | Column | None = None) -> DataFrame:
    """Triggers and documents of every key in order: ``(keys, pos, session_id, event, cause, applied, at_ns,
    since_ns, boundary, live_from, gap_at)``.

    ``event`` is ``trigger`` (with its ``cause``, and whether it was ``applied``), ``snapshot`` (accepted, with its
    boundary and the range of its buffered deltas) or ``ignored_snapshot``. The session of an applied trigger is
    the one that it opens. A timeout takes effect after its position. With ``horizon_ns`` silence at
    the end of a key counts up to there.
    """
    seq = F.col("seq") if "seq" in frames.columns else F.lit(None)
    # A filter on the generator's output stays above it; one on the column would repeat the parse that made it.
    kind = F.explode_outer(F.array("kind")).alias("kind")
    rows = frames.select(*lane.keys, lane.pos, kind, F.col("at_ns").cast("bigint").alias("at_ns"), seq.cast("bigint").alias("seq"))
    used = rows.where(F.col("kind").isNotNull())
    if horizon_ns is not None:
        end = F.lit("end").alias("kind")
        last = frames.groupBy(*lane.keys).agg((F.max(lane.pos) + 1).alias(lane.pos))
        used = used.unionByName(last.select(*lane.keys, lane.pos, end, F.lit(horizon_ns).cast("bigint").alias("at_ns"), F.lit(None).cast("bigint").alias("seq")))
    return fold_buckets(used, rules, lane, (lambda placed: _guesses(placed, rules, lane)) if rules.timeout is not None else None)


def trigger_table(events: DataFrame, *keep: str) -> DataFrame:
    """Every request for recovery, whatever caused it, with its reason code and outcome."""
    cause = F.col("cause")
    reason = F.lit(None).cast("string")
    for name, code in REASONS.items():
        reason = F.when(cause == name, code).otherwise(reason)
    return events.where("event = 'trigger'").select(
        *keep,
        "session_id",
        "at_ns",
        F.lit("RESET").alias("request_type"),
        reason.alias("reason_code"),
        cause.alias("text"),
        F.when(F.col("applied"), "applied").otherwise("ignored").alias("outcome"),
    )


def sessions(events: DataFrame, lane: Lane = LANE) -> DataFrame:
    """One row per session that anything happened in: ``(keys, session_id, from_pos, cause, accepted_at, boundary,
    live_from, gap_at)``. Rows above ``from_pos`` belong to it; ``from_pos`` is null for a key's first one."""
    pos = F.col(lane.pos)
    opened, taken = F.col("applied"), F.col("event") == "snapshot"
    return events.groupBy(*lane.keys, "session_id").agg(
        F.max(F.when(opened, pos)).alias("from_pos"),
        F.max(F.when(opened, F.col("cause"))).alias("cause"),
        F.max(F.when(taken, pos)).alias("accepted_at"),
        *[F.max(F.when(taken, F.col(c))).alias(c) for c in ("boundary", "live_from", "gap_at")],
    )


def session_feed(frames: DataFrame, events: DataFrame, lane: Lane = LANE) -> DataFrame:
    """Add ``session_id``, ``disposition`` and ``gateway_seq`` to the rows of a buffered feed.

    Deltas before their session's document are ``stale``, ``replayed``, the ``gap`` or ``dropped`` behind it; those
    after it are ``published``; those of a session without a document are ``pre_snapshot`` drops. The
    gateway sequence counts the document, the replayed and the published deltas of a session from 1.
    """
    columns = frames.columns
    pos, part = F.col(lane.pos), list(lane.keys)
    named = sessions(events, lane)
    told = ["session_id", "accepted_at", "live_from", "gap_at"]
    # Rows at even places, the start of a session right behind the row that it follows.
    place = (2 * pos).cast("bigint")
    rows = frames.select("*", place.alias("_place"), F.lit(None).cast("struct<session_id:bigint,accepted_at:bigint,live_from:bigint,gap_at:bigint>").alias("_told"))
    starts = named.select(
        *part, (2 * F.coalesce("from_pos", F.lit(-1)) + 1).cast("bigint").alias("_place"), F.struct(*told).alias("_told")
    )
    both = rows.unionByName(starts, allowMissingColumns=True)
    filled = running(both, Lane(tuple(part), "_place", lane.width), _now=max_before(F.when(F.col("_told").isNotNull(), F.struct("_place", "_told"))))
    now = F.col("_now._told")
    filled = filled.where("_told is null").withColumn("session_id", F.coalesce(now["session_id"], F.lit(0)).cast("bigint"))
    delta, accepted = F.col("kind").isin(*DELTAS), now["accepted_at"]
    waited = (
        F.when(now["live_from"].isNull() | (pos < now["live_from"]), "stale")
        .when(now["gap_at"].isNull() | (pos < now["gap_at"]), "replayed")
        .when(pos == now["gap_at"], "gap")
        .otherwise("dropped")
    )
    outcome = F.when(delta & accepted.isNull(), "pre_snapshot").when(delta & (pos < accepted), waited).when(delta, "published")
    outcome = outcome.when((F.col("kind") == "snapshot") & F.coalesce(pos == accepted, F.lit(False)), "accepted_snapshot")
    outcome = outcome.when(F.col("kind") == "snapshot", "ignored_snapshot").otherwise(F.col("kind"))
    judged = filled.withColumn("disposition", outcome)
    sent = F.col("disposition").isin("replayed", "published")
    counted = running(judged.drop("_place", "_told", "_now", BUCKET), Lane((*part, "session_id"), lane.pos, lane.width), _sent=sum_upto(sent.cast("bigint")))
    number = F.when(sent, F.col("_sent") + 1).when(F.col("disposition") == "accepted_snapshot", 1)
    return counted.select(*columns, "session_id", "disposition", number.cast("bigint").alias("gateway_seq"))
