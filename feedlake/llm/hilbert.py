"""Sharding along a Hilbert curve: quantise metadata, sort by the curve index, cut equal runs.

Dimensions are source, language and text size (log scale). Equal texts form a group that takes the
smallest source and language of its rows, so that copies stand together on the curve. Ranks are exact:
rows are range-partitioned on (curve index, text, id), which splits any hot cell, the split is fixed in
the shared folder, rows are numbered inside their run and shifted by the sizes of the runs before.

Law ``rows``: shard = rank * shards div rows, so the row counts differ by one at most.

Defined results: null source, language and text are values of their own (a null text has size 0 + 1 byte
and the checksum of the empty text); rows that are equal in every used column are interchangeable;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.session import fresh_path

BITS = 7
DIMENSIONS = ("_source", "_lang", "_size")


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (one row per point), by Skilling's transpose."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _index_column(columns):
    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.column_stack([a, b, c])))

    return index(*columns)


def _quantised() -> dict:
    """Cells 0 to 2^BITS - 1: names by hash (0 for null), sizes by quarters of a power of two."""
    top = (1 << BITS) - 1

    def named(column):
        return F.when(F.col(column).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(column), F.lit(top))).cast("long")

    size = F.least(F.floor(F.log2(F.col("size").cast("double")) * 4), F.lit(top)).cast("long")
    return {"_source": named("_group_source"), "_lang": named("_group_lang"), "_size": size}


def _differ(column: str):
    """Whether a group's values of a column are not all the same, null being a value."""
    some, all_ = F.count(column), F.count(F.lit(1))
    return (F.min(column) != F.max(column)).eqNullSafe(F.lit(True)) | ((some > 0) & (some < all_))


def placed(docs: DataFrame, shards: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve index, shard and slot (rank in the shard, from 0) of every row,
    with the columns ``carry`` of the row in a struct ``row``."""
    spark = docs.sparkSession
    runs = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.col("source").alias("_row_source"),
        F.col("lang").alias("_row_lang"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        F.struct(*[docs[c] for c in carry]).alias("row") if carry else F.lit(None).cast("int").alias("row"),
    )
    folder = fresh_path(spark, "hilbert")
    same = ["_text", "size", "text_crc32"]
    # Only equal texts of different source or language need their group; a table of its own, so that the
    # planner knows its size and can split a hot group.
    group = base.groupBy(*same).agg(
        F.min("_row_source").alias("_group_source"),
        F.min("_row_lang").alias("_group_lang"),
        *[_differ(c).alias(f"_differ{c}") for c in ("_row_source", "_row_lang")],
    )
    group = group.where("_differ_row_source or _differ_row_lang").select(*same, "_group_source", "_group_lang", F.lit(True).alias("_grouped"))
    group.write.parquet(f"{folder}/groups")
    group = spark.read.schema(group.schema).parquet(f"{folder}/groups")
    own = {f"_group_{k}": F.expr(f"if(_grouped, _group_{k}, _row_{k})") for k in ("source", "lang")}
    keyed = base.join(group, same, "left").withColumns(own).withColumns(_quantised())
    keyed = keyed.withColumn("curve", _index_column([F.col(d) for d in DIMENSIONS]))
    # The last key only parts rows that are equal in all the others, so that no run holds too many.
    keyed = keyed.withColumn("_tie", F.monotonically_increasing_id())
    order = ["curve", "_text", "doc_id", "_row_source", "_row_lang", "_tie"]
    ranged = keyed.repartitionByRange(runs, *order).sortWithinPartitions(*order)
    # The id counts the rows of a partition in its lower 33 bits; written, so that the split is fixed.
    ranged = ranged.select("doc_id", "size", "text_crc32", "curve", "row", F.monotonically_increasing_id().alias("_id"))
    ranged.withColumn("_run", F.shiftright("_id", 33)).write.parquet(f"{folder}/runs")
    split = spark.read.parquet(f"{folder}/runs")
    heads = split.groupBy("_run").agg(F.min("_id").alias("_head"), F.count(F.lit(1)).alias("_count"))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shift = heads.select(  # one row per run
        "_run",
        (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_head")).alias("_shift"),
        F.sum("_count").over(everything).alias("_rows"),
    )
    shift.write.parquet(f"{folder}/shifts")
    shift = spark.read.schema(shift.schema).parquet(f"{folder}/shifts")
    ranked = split.join(shift, "_run").withColumn("_rank", F.expr("_id + _shift"))
    ranked = ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div _rows as int)"))
    first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")  # the smallest rank of the shard
    return ranked.select(
        "doc_id", "size", "text_crc32", "curve", "shard", (F.col("_rank") - first).cast("long").alias("slot"), "row"
    )


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and ``slot`` (replacing columns of that name)."""
    names = tuple(c for c in docs.columns if c not in ("shard", "slot"))
    rows = placed(docs, shards, carry=names)
    return rows.select(*[F.col("row")[n].alias(n) for n in names], "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard; inside, rows follow the curve, so file statistics prune on every dimension."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
