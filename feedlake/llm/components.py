"""Connected components of an edge table by alternating large-star and small-star steps (union-find by
joins). Edges stay distributed; each step is written to the shared folder, so lost executors cost no
more than one step. A hub is no problem: minima combine before the shuffle and the join back on the hub
can be split by the adaptive planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import fresh_path

MAX_STEPS = 60


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node that has an edge.

    Loops and null ends are ignored; repeated edges count once; an empty table gives an empty result.
    """
    folder = fresh_path(edges.sparkSession, "components")
    a, b = F.col(u), F.col(v)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = _stored(pairs.distinct(), f"{folder}/0")
    seen = None
    for step in range(1, MAX_STEPS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node move to its smallest neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: the node and its neighbours below move to the smallest of them.
        below = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = below.groupBy("u").agg(F.min("v").alias("m"))
        moved = below.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        now = _stored(small, f"{folder}/{step}")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
