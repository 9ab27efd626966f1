"""Bounded capture: the last N messages per key, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.ordering import BUCKET, Lane


def last_n(messages: DataFrame, n: int, lane: Lane = Lane()) -> DataFrame:
    """Last ``n`` rows per key with ``age`` (1 = newest) and ``total`` published per key.

    The cut runs per (key, bucket) first, so only ``n`` rows per bucket reach the final ranking.
    """
    placed = lane.bucketed(messages)
    newest = F.row_number().over(Window.partitionBy(*lane.part).orderBy(F.desc(lane.pos)))
    survivors = placed.withColumn("age", newest).where(F.col("age") <= n)
    newest = F.row_number().over(Window.partitionBy(*lane.keys).orderBy(F.desc(lane.pos)))
    kept = survivors.withColumn("age", newest).where(F.col("age") <= n).drop(BUCKET)
    totals = messages.groupBy(*lane.keys).agg(F.count("*").alias("total"))
    return kept.join(totals, list(lane.keys))


def last_n_overall(messages: DataFrame, n: int, *order: str) -> DataFrame:
    """Last ``n`` rows of the whole stream; Spark keeps ``n`` rows per task before merging."""
    return messages.orderBy(*[F.desc(c) for c in order]).limit(n)
