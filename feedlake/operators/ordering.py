"""Ordered folds over a stream per key, without ever putting one key into one task.

A stream is a set of rows per ``keys`` in the order of a unique integer ``pos``. Rows are cut into
position buckets of ``width``: because positions are unique within a key, a bucket can never hold
more than ``width`` rows, however hot the key is. A fold then runs in three steps:

1. inside every (key, bucket) with ordinary windows,
2. over one summary row per (key, bucket) to get the state each bucket starts with,
3. joined back on (key, bucket).

The shuffle key is (key, bucket), so a hot key is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from feedlake.session import reliable_checkpoint

BUCKET_ROWS = 1 << 20
BUCKET = "_bucket"
SALTS = 32


@dataclass(frozen=True)
class Lane:
    """How a stream is keyed and ordered.

    ``sparse`` adds a second bucket level for positions that are not dense (offsets shared by many
    keys, clock values), so that the summary table of a hot key is itself folded in buckets.
    """

    keys: tuple[str, ...] = ("instrument_id",)
    pos: str = "arrival"
    width: int = BUCKET_ROWS
    sparse: bool = False

    @property
    def part(self) -> list[str]:
        return [*self.keys, BUCKET]

    def bucketed(self, df: DataFrame) -> DataFrame:
        """Shuffle ``df`` by (keys, bucket); a frame that already carries its bucket is left alone.

        The shuffle is explicit: a frame partitioned by the key alone would satisfy the windows below
        and keep a hot key in one task. It also gives the rows and their summary branch one common
        exchange. Rows without key or position belong to no stream.
        """
        if BUCKET in df.columns:
            return df
        placed = df.withColumn(BUCKET, F.expr(f"`{self.pos}` div {self.width}"))
        for name in self.part:
            placed = placed.where(F.col(name).isNotNull())
        return placed.repartition(*self.part)

    @staticmethod
    def released(result: DataFrame, source: DataFrame) -> DataFrame:
        """Drop the bucket column unless the caller's frame already carried it."""
        return result if BUCKET in source.columns else result.drop(BUCKET)

    def inside(self) -> WindowSpec:
        """Window of one (key, bucket) in stream order."""
        return Window.partitionBy(*self.part).orderBy(self.pos)

    def upto(self) -> WindowSpec:
        return self.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before(self) -> WindowSpec:
        return self.inside().rowsBetween(Window.unboundedPreceding, -1)

    def across(self) -> WindowSpec:
        """Window over the bucket summaries of one key."""
        return Window.partitionBy(*self.keys).orderBy(BUCKET)


@dataclass(frozen=True)
class Run:
    """A running ``sum`` or ``max`` of ``expr``, with or without the current row."""

    kind: str
    expr: Column
    inclusive: bool = True

    def aggregate(self, column: Column) -> Column:
        return F.sum(column) if self.kind == "sum" else F.max(column)


def sum_upto(expr: Column) -> Run:
    return Run("sum", expr)


def sum_before(expr: Column) -> Run:
    return Run("sum", expr, inclusive=False)


def max_upto(expr: Column) -> Run:
    return Run("max", expr)


def max_before(expr: Column) -> Run:
    return Run("max", expr, inclusive=False)


def running(df: DataFrame, lane: Lane, **runs: Run) -> DataFrame:
    """Add running sums and maxima per key in stream order, exact across buckets.

    The maximum of ``struct(pos, ...)`` is the usual way to carry "the last row such that".
    """
    placed = lane.bucketed(df)
    rows = placed
    for name, run in runs.items():
        rows = rows.withColumn(name, run.aggregate(run.expr).over(lane.upto() if run.inclusive else lane.before()))
    totals = placed.groupBy(*lane.part).agg(
        *[run.aggregate(run.expr).alias(f"_in_{name}") for name, run in runs.items()]
    )
    if lane.sparse:
        outer = replace(lane, pos=BUCKET, sparse=False)
        carried = running(
            totals.withColumnRenamed(BUCKET, "_pos"),
            replace(outer, pos="_pos"),
            **{f"_in_{n}": Run(r.kind, F.col(f"_in_{n}"), inclusive=False) for n, r in runs.items()},
        ).withColumnRenamed("_pos", BUCKET)
    else:
        earlier = lane.across().rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *lane.part, *[r.aggregate(F.col(f"_in_{n}")).over(earlier).alias(f"_in_{n}") for n, r in runs.items()]
        )
    joined = rows.join(carried, lane.part)
    for name, run in runs.items():
        here, carry = F.col(name), F.col(f"_in_{name}")
        if run.kind == "sum":
            whole = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            whole = F.greatest(here, carry)
        joined = joined.withColumn(name, whole)
    return lane.released(joined.drop(*[f"_in_{n}" for n in runs]), df)


def dense_arrival(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "arrival") -> DataFrame:
    """Number the rows of each key 1, 2, 3, ... in ``order`` (which must be unique per key).

    Rows are range-partitioned on (keys, order), which splits a hot key over as many tasks as it needs
    (their number is the session's ``spark.sql.shuffle.partitions``), sorted, and written to the shared
    checkpoint folder with their place in the run. A key's rank in a run is then the distance to its
    first row there plus its rows in the runs before; only these per-run counts are joined back.
    """
    runs = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(runs, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id counts the rows of a partition in its lower 33 bits.
    placed = reliable_checkpoint(ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_run", F.shiftright("_id", 33))
    part = [*keys, "_run"]
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(*part).agg(F.min("_id").alias("_head"), F.count(F.lit(1)).alias("_rows"))
    offset = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_head") + 1
    shift = heads.select(*[F.col(c).alias(f"_of_{c}") for c in part], offset.alias("_shift"))
    joined = placed.join(shift, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part])
    rank = (F.col("_id") + F.col("_shift")).cast("bigint").alias(name)
    return joined.select(*[c for c in df.columns if c != name], rank)


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", spread: str = "arrival"
) -> DataFrame:
    """Equi-join of a stream with a one-row-per-key table, safe for a hot key.

    The small side is repeated per salt, so a hot key of the big side is spread over ``SALTS`` tasks.
    Only the salts are broadcast: the adaptive planner broadcasts the side only after it has measured it.
    """
    # A product, since the planner takes exploded rows for no larger than the rows that they come from.
    salts = big.sparkSession.range(SALTS).select(F.col("id").cast("int").alias("_salt"))
    salted = small.crossJoin(F.broadcast(salts))
    return (
        big.withColumn("_salt", F.expr(f"cast(pmod(`{spread}`, {SALTS}) as int)"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )
