"""Session rules over micro-batches with the bucketed folds of the batch form.

Each micro-batch is folded exactly like a table, starting from the state table the micro-batch before
it left in the shared folder. A hot instrument is spread over its position buckets here too. Rows behind
the state of their own stream are told as ``late`` and change nothing, as in the keyed form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators.ordering import BUCKET, Lane
from feedlake.operators.session_state import TRIGGERS, apply_session_rules
from feedlake.session import delete_folder

STATE_SCHEMA = "last_arrival bigint, is_open boolean, recovering boolean, session bigint, seq bigint"
_RESTORED = "_restored"


def _carried() -> list[Column]:
    """The state as columns that the rows of its stream carry."""
    return [
        F.col("last_arrival").alias("_last"),
        F.col("is_open").alias("_gate"),
        F.col("recovering").cast("int").alias("_at_recovery"),
        F.col("session").alias("_at_session"),
        F.col("seq").alias("_at_seq"),
    ]


def _split_late(classified: DataFrame, state: DataFrame, lane: Lane) -> tuple[DataFrame, DataFrame]:
    """Rows ahead of the state, which they carry, and the late ones with the outcome that the keyed form gives them."""
    # The state meets one row per (stream, bucket), these meet the rows: no row of the state is repeated per salt.
    placed = lane.bucketed(classified)
    heads = placed.select(*lane.part).distinct().join(state.select(*lane.keys, *_carried()), list(lane.keys), "left")
    met = placed.join(heads, lane.part).drop(BUCKET)
    ahead = F.coalesce(F.col(lane.pos) > F.col("_last"), F.lit(True))
    late = met.where(~ahead).withColumns(
        {
            "disposition": F.lit("late"),
            "open_before": F.col("_gate"),
            "open_after": F.col("_gate"),
            "attempt": F.lit(False),
            "ignored": F.lit(False),
            "session_id": F.col("_at_session"),
            "gateway_seq": F.lit(None).cast("bigint"),
        }
    )
    return met.where(ahead), late.drop("_last", "_gate", "_at_recovery", "_at_session", "_at_seq")


def resume_session_rules(classified: DataFrame, state: DataFrame, lane: Lane = Lane()) -> tuple[DataFrame, DataFrame]:
    """Rules over the next rows of each stream; returns the rows and the state after them.

    The carried state enters as one row per stream just before its new rows: an accepted snapshot when the
    gate was open, a trigger when a recovery was open, nothing otherwise. Rows at or behind the carried
    position are late.
    """
    moved, late = _moved(classified, state, lane)
    return _told(moved, late), _state_after(moved, state, lane)


def _moved(classified: DataFrame, state: DataFrame, lane: Lane) -> tuple[DataFrame, DataFrame]:
    """The ruled rows with those of the state before them, and the late rows."""
    fresh, late = _split_late(classified, state, lane)
    kind = F.when(F.col("is_open"), "snapshot").when(F.col("recovering"), "trigger").otherwise("idle")
    seeds = state.select(
        *lane.keys, F.col("last_arrival").alias(lane.pos), kind.alias("kind"), F.lit(True).alias(_RESTORED), *_carried()
    )
    rows = fresh.withColumn(_RESTORED, F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    ruled = apply_session_rules(rows, lane)
    recovering, opened = F.coalesce("_at_recovery", F.lit(0)), F.coalesce(F.col("_gate").cast("int"), F.lit(0))
    same_session = F.col("session_id") == recovering
    continued = F.when(
        same_session, F.col("gateway_seq") - opened + F.coalesce("_at_seq", F.lit(0))
    ).otherwise(F.col("gateway_seq"))
    shifted = ruled.withColumn("gateway_seq", continued).withColumn(
        "session_id", F.col("session_id") - recovering + F.coalesce("_at_session", F.lit(0))
    )
    return shifted.drop("_last", "_gate", "_at_recovery", "_at_session", "_at_seq"), late


def _state_after(moved: DataFrame, state: DataFrame, lane: Lane) -> DataFrame:
    keys = list(lane.keys)
    # A carried session without new messages keeps its sequence through the restored row.
    at_end = F.struct("session_id", F.coalesce("gateway_seq", F.lit(0)).alias("seq"))
    seen = F.col("kind").isin("snapshot", *TRIGGERS)
    ends = moved.groupBy(*keys).agg(
        F.max(lane.pos).alias("last_arrival"),
        F.max_by("open_after", lane.pos).alias("is_open"),
        F.max(seen.cast("int")).alias("_seen"),
        F.max(at_end).alias("_end"),
    )
    seeds_seq = state.select(*keys, F.col("session").alias("_s"), F.col("seq").alias("_q"))
    return ends.join(seeds_seq, keys, "left").select(
        *keys,
        "last_arrival",
        "is_open",
        (~F.col("is_open") & (F.col("_seen") == 1)).alias("recovering"),
        F.col("_end.session_id").alias("session"),
        F.greatest(
            F.col("_end.seq"), F.when(F.col("_s") == F.col("_end.session_id"), F.col("_q")).otherwise(F.lit(0))
        ).alias("seq"),
    )


def _told(moved: DataFrame, late: DataFrame) -> DataFrame:
    return moved.where(~F.col(_RESTORED)).drop(_RESTORED).unionByName(late, allowMissingColumns=True)


def fold_batches(
    spark: SparkSession, state_path: str, sink: Callable[[DataFrame, int], None], lane: Lane = Lane()
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. State of batch N is written once under ``epoch=N``; a batch that is
    repeated after a failure starts from the same N-1 and writes the same result. Once batch N is done no
    earlier batch than N can be repeated, so the state before N-1 goes."""

    def step(batch: DataFrame, batch_id: int) -> None:
        keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.select(*lane.keys).schema) + ", "
        if batch_id == 0:
            state = spark.createDataFrame([], keys + STATE_SCHEMA)
        else:
            state = spark.read.schema(keys + STATE_SCHEMA).parquet(f"{state_path}/epoch={batch_id - 1}")
        batch.persist()
        moved, late = _moved(batch, state, lane)
        moved.persist()  # for the state and for the sink
        try:
            _state_after(moved, state, lane).write.mode("overwrite").parquet(f"{state_path}/epoch={batch_id}")
            sink(_told(moved, late), batch_id)
            if batch_id > 1:
                delete_folder(spark, f"{state_path}/epoch={batch_id - 2}")
        finally:
            moved.unpersist()
            batch.unpersist()

    return step
