"""Counters of a stream: a table of totals that every micro-batch moves on.

A micro-batch is summed like a table, one row per key, and merged into the totals of the batch before it. What is not
a plain sum carries what a later merge needs: the smallest latency after the last zero (a stored zero reads as
unset), or the first and last edge of a connection. The totals after a batch equal the batch counters of all rows so
far. Only summaries meet the totals, so a hot key is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import delete_folder
from feedlake.streaming.sink import last_commit

Merge = Callable[[Column, Column], Column]
Sink = Callable[[DataFrame, int], None]


def added(old: Column, new: Column) -> Column:
    return old + new


def earliest(old: Column, new: Column) -> Column:
    return F.least(old, new)


def latest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def latency_merged(old: Column, new: Column) -> Column:
    """Of two ``latency_summary`` structs; the later one decides from its last zero on."""
    return F.struct(
        (old["zero"] | new["zero"]).alias("zero"),
        F.when(new["zero"], new["low"]).otherwise(F.least(old["low"], new["low"])).alias("low"),
        F.greatest(old["high"], new["high"]).alias("high"),
        new["last"].alias("last"),
    )


def edges_merged(old: Column, new: Column) -> Column:
    """Of two ``connection_summary`` structs; the first edge of the later one counts if it changes the state."""
    turned = (new["first"] != old["last"]).cast("bigint")
    return F.struct(
        old["first"].alias("first"),
        new["last"].alias("last"),
        (old["opens"] + new["opens"] + turned * new["first"]).alias("opens"),
        (old["closes"] + new["closes"] + turned * (1 - new["first"])).alias("closes"),
    )


def _moved_on(totals: DataFrame, summary: DataFrame, keys: list[str], merges: Mapping[str, Merge]) -> DataFrame:
    names = [c for c in summary.columns if c not in keys]
    both = totals.withColumn("_new", F.lit(False)).unionByName(summary.withColumn("_new", F.lit(True)))
    # One row of each kind per key: max only picks it.
    picked = [F.max(F.when(F.col("_new") == kind, F.struct(*names))).alias(name) for name, kind in (("_a", False), ("_b", True))]
    met = both.groupBy(*keys).agg(*picked)

    def merged(name: str) -> Column:
        old, new = F.col("_a")[name], F.col("_b")[name]
        value = merges.get(name, added)(old, new)
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(value).alias(name)

    return met.select(*keys, *[merged(n) for n in names])


def accumulate(
    path: str,
    keys: list[str],
    summary: Callable[[DataFrame], DataFrame],
    merges: Mapping[str, Merge] | None = None,
    publish: Sink | None = None,
) -> Sink:
    """A ``foreachBatch`` function that keeps totals under ``path`` and shows them to ``publish`` after every batch.

    ``summary`` gives one row per key of a micro-batch; its columns are summed unless ``merges`` says otherwise. Batch
    N starts from the totals of N-1, which stay until N+1 is done, so a batch that is repeated after a failure writes
    the same again. A new checkpoint needs a new ``path``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        totals = summary(batch)
        if batch_id > 0:
            before = spark.read.schema(totals.schema).parquet(f"{path}/commit={batch_id - 1}")
            totals = _moved_on(before, totals, keys, merges or {})
        totals.write.mode("overwrite").parquet(f"{path}/commit={batch_id}")
        if publish is not None:
            publish(spark.read.schema(totals.schema).parquet(f"{path}/commit={batch_id}"), batch_id)
        if batch_id > 1:
            delete_folder(spark, f"{path}/commit={batch_id - 2}")

    return step


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals after the last finished batch of :func:`accumulate`."""
    last = last_commit(spark, path)
    if last < 0:
        raise ValueError(f"no finished batch in {path}")
    return spark.read.parquet(f"{path}/commit={last}")


def each(*sinks: Sink) -> Sink:
    """One sink from several: the batch is computed once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return step
