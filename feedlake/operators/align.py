"""Snapshot/delta alignment, buffer overflow and sequence gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.ordering import BUCKET, Lane, max_before, running, spread_join, sum_upto

LANE = Lane()
# Fixed value: delta slots of the pre-snapshot buffer; one slot stays free.
BUFFER_SLOTS = 512


def align_deltas(deltas: DataFrame, snapshots: DataFrame, lane: Lane = LANE) -> DataFrame:
    """Add ``outcome`` to each delta against its snapshot's ``boundary`` sequence N, one snapshot per key.

    ``stale``: the prefix up to the first sequence above N. The first kept delta must be N+1 and every
    later one must follow its predecessor; the first that does not is the ``gap``, what comes after
    it is ``dropped``. Everything else is ``replayed``. Several snapshots per key: :func:`align_segments`.
    """
    keys = list(lane.keys)
    bounded = lane.bucketed(spread_join(deltas, snapshots.select(*keys, "boundary"), keys, spread=lane.pos))
    return _judged(bounded, lane).drop(BUCKET)


def _judged(bounded: DataFrame, lane: Lane) -> DataFrame:
    """Outcomes of deltas that carry their ``boundary``."""
    pos = F.col(lane.pos)
    # "Has any row so far exceeded N" needs only a running maximum; "before" tells the first such row.
    swept = running(
        bounded,
        lane,
        _past=max_before(F.when(F.col("seq") > F.col("boundary"), 1)),
        _prev=max_before(F.struct(pos, "seq")),
    )
    live = F.col("_past").isNotNull() | (F.col("seq") > F.col("boundary"))
    expected = F.when(F.col("_past").isNull(), F.col("boundary")).otherwise(F.col("_prev.seq")) + 1
    flagged = swept.withColumn("_live", live).withColumn("_gap", live & (F.col("seq") != expected))
    broken = running(flagged, lane, _gaps=sum_upto(F.col("_gap").cast("int")))
    outcome = (
        F.when(~F.col("_live"), "stale")
        .when(F.col("_gaps") == 0, "replayed")
        .when(F.col("_gap") & (F.col("_gaps") == 1), "gap")
        .otherwise("dropped")
    )
    return broken.withColumn("outcome", outcome).drop("_past", "_prev", "_live", "_gap", "_gaps")


def align_segments(deltas: DataFrame, snapshots: DataFrame, slots: int = BUFFER_SLOTS, lane: Lane = LANE) -> DataFrame:
    """Add ``snapshot_at``, ``boundary`` and ``outcome`` to each delta, with any number of snapshots per key.

    ``snapshots`` are (keys, position, boundary). A delta waits for the next snapshot of its key; those between two
    snapshots are one segment, aligned as in :func:`align_deltas`. A segment of more than ``slots - 1``
    deltas is an ``overflow``: its snapshot is ignored. Behind the last snapshot deltas are ``pending``.
    Where a hole or an overflow opens a new session instead: :mod:`feedlake.operators.session_feed`.
    """
    keys, columns = list(lane.keys), deltas.columns
    # Backwards the next snapshot is the last one seen.
    back = Lane(lane.keys, "_back", lane.width)
    marks = snapshots.select(*keys, (-F.col(lane.pos)).alias("_back"), F.struct((-F.col(lane.pos)).alias("_back"), "boundary").alias("_mark"))
    both = deltas.withColumn("_back", -F.col(lane.pos)).unionByName(marks, allowMissingColumns=True)
    told = running(both, back, _next=max_before(F.col("_mark"))).where("_mark is null")
    named = told.withColumns({"snapshot_at": -F.col("_next._back"), "boundary": F.col("_next.boundary")}).drop("_back", "_mark", "_next")
    segment = Lane((*lane.keys, "snapshot_at"), lane.pos, lane.width)
    waiting = segment.bucketed(named.where("snapshot_at is not null"))
    # One row per (segment, bucket): nothing is repeated, and a long segment stays in its buckets.
    whole = F.sum("_held").over(Window.partitionBy(*segment.keys))
    held = waiting.groupBy(*segment.part).agg(F.count(F.lit(1)).alias("_held"))
    held = held.select(*segment.part, (whole > slots - 1).alias("_over"))
    judged = _judged(waiting, segment).join(held, segment.part).drop(BUCKET)
    judged = judged.withColumn("outcome", F.when(F.col("_over"), "overflow").otherwise(F.col("outcome")))
    open_end = named.where("snapshot_at is null").withColumn("outcome", F.lit("pending"))
    wanted = [*columns, "snapshot_at", "boundary", "outcome"]
    return judged.select(*wanted).unionByName(open_end.select(*wanted))


def alignment_summary(aligned: DataFrame, *keys: str) -> DataFrame:
    """Counts per key; a gap means recovery."""
    outcome = F.col("outcome")
    return aligned.groupBy(*keys).agg(
        *[F.count_if(outcome == o).alias(o) for o in ("stale", "replayed", "gap", "dropped")],
        F.max(F.when(outcome == "replayed", F.col("seq"))).alias("last_seq"),
    )


def buffer_overflow(deltas: DataFrame, snapshots: DataFrame, slots: int = BUFFER_SLOTS, lane: Lane = LANE) -> DataFrame:
    """Pending snapshots with more than ``slots - 1`` deltas before them: reset, snapshot ignored.

    ``snapshots`` carries the position at which each key's snapshot arrives.
    """
    keys = list(lane.keys)
    at = snapshots.select(*keys, F.col(lane.pos).alias("_at"))
    waiting = spread_join(deltas, at, keys, spread=lane.pos).where(F.col(lane.pos) < F.col("_at"))
    counted = waiting.groupBy(*keys).agg(F.count("*").alias("buffered"))
    return counted.withColumn("overflow", F.col("buffered") > slots - 1)


def sequence_gaps(rows: DataFrame, seq: str = "seq", lane: Lane = LANE) -> DataFrame:
    """Add ``prev_seq``, ``missing`` (how many sequences were skipped) and ``out_of_order``."""
    traced = running(rows, lane, _prev=max_before(F.struct(F.col(lane.pos), F.col(seq))))
    prev, here = F.col(f"_prev.{seq}"), F.col(seq)
    return (
        traced.withColumn("prev_seq", prev)
        .withColumn("missing", F.when(here > prev + 1, here - prev - 1).otherwise(F.lit(0).cast("bigint")))
        .withColumn("out_of_order", F.coalesce(here <= prev, F.lit(False)))
        .drop("_prev")
    )


def replay_order(aligned: DataFrame, snapshots: DataFrame, *keys: str, pos: str = "arrival") -> DataFrame:
    """What leaves the alignment, in order: the snapshot (``stage`` 0), then its replayed deltas (``stage`` 1).

    Replayed deltas follow the boundary without a hole, so their place ``replay_pos`` is the distance to it.
    """
    head = snapshots.select(
        *keys, F.lit(0).alias("stage"), F.lit(None).cast("bigint").alias(pos), F.col("boundary").cast("bigint").alias("seq"),
        F.lit(0).cast("bigint").alias("replay_pos"),
    )
    place = (F.col("seq") - F.col("boundary")).cast("bigint").alias("replay_pos")
    return head.unionByName(
        aligned.where("outcome = 'replayed'").select(*keys, F.lit(1).alias("stage"), pos, "seq", place)
    )
