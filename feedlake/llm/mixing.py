"""Mixing sources to target weights by balanced sampling (cube method).

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``budget`` times the
corpus size; a target stops at ``most`` times its source's size and the excess is shared again by weight.
A document of a source with target t and size S is taken floor(t / S) times for certain and once more
with probability frac(t / S). Which documents get the extra copy is decided by the cube method: the
vector of inclusion probabilities walks through the null space of the balancing constraints (documents
and words of the source), three undecided documents at a time, until each is 0 or 1. At most two stay
open per block; they walk on together in the next level, until one block per source is left, whose last
two are rounded to the side that leaves the smaller error (the landing).

A block holds about ``BLOCK`` rows by hash, however large the source, so no task sees a whole source.
Reruns agree: the walk's coins are hashes of id and level.

Defined results: null text has size 0; a source whose documents are all empty takes nothing; null
source is a source of its own; rows with the same id are separate documents; empty table, empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.textblocks import U64, mix
from feedlake.session import fresh_path

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
BLOCK = 2048


MATCH = ("doc_id", "source", "size")


def word_count(text: str = "text"):
    """Number of runs of characters outside space and \\x09-\\x0D; 0 for null."""
    padded = F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit("")), F.lit(" "))
    return (F.size(F.split(padded, r"[\x20\x09-\x0D]+")) - 2).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sizes`` has source, source_size and source_rows, one row per source; adds ``target``.

    Water filling: with sources ordered by cap / weight, the first k stop at their caps and the others
    share what is left; k is the smallest number for which no further source is above its cap.
    """
    count = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % count + 1)
    rows = sizes.withColumn("_weight", weight.cast("double"))
    rows = rows.withColumn("_cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "_caps": F.sum("_cap").over(upto) - F.col("_cap"),
            "_heavier": F.sum("_weight").over(total) - F.sum("_weight").over(upto) + F.col("_weight"),
            "_all": F.sum("source_size").over(total),
        }
    )
    # The level if exactly the sources before this one stop; this source is open where it stays below its cap.
    level = (budget * F.col("_all") - F.col("_caps")) / F.col("_heavier")
    rows = rows.withColumn("_level", level)
    open_ = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    shared = F.first(open_, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_shared", shared)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_shared") * F.col("_weight"), F.col("_cap")))
    return rows.select("source", "source_size", "source_rows", target.alias("target"))


def walk(chance: np.ndarray, words: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Flight phase over one block: at most two entries stay strictly between 0 and 1.

    Three open units span a one-dimensional null space of the two constraints (sum of chance and sum of
    chance times words keep their values): its direction is (w3 - w2, w1 - w3, w2 - w1).
    """
    p = chance.tolist()
    w = words.tolist()
    coin = coins.tolist()
    open_: list[int] = []
    for unit in range(len(p)):
        if not 1e-9 < p[unit] < 1 - 1e-9:
            p[unit] = float(round(p[unit]))
            continue
        open_.append(unit)
        if len(open_) < 3:
            continue
        a, b, c = open_
        step = (w[c] - w[b], w[a] - w[c], w[b] - w[a])
        if step == (0, 0, 0):
            step = (1, -1, 0)  # equal sizes: any exchange keeps both sums
        up = down = float("inf")
        for i, s in zip(open_, step, strict=True):
            if s > 0:
                up, down = min(up, (1 - p[i]) / s), min(down, p[i] / s)
            elif s < 0:
                up, down = min(up, p[i] / -s), min(down, (1 - p[i]) / -s)
        move = up if coin[unit] * (up + down) < down else -down
        for i, s in zip(open_, step, strict=True):
            p[i] += move * s
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        open_ = [i for i in open_ if 0 < p[i] < 1]
        if len(open_) == 3:  # lost in rounding: settle the nearest one
            near = min(open_, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = float(round(p[near]))
            open_.remove(near)
    return np.array(p)


def land(chance: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Round the last open units (two at most) to the 0/1 values that miss the word total least."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    best, done = None, chance.copy()
    for code in range(1 << len(open_)):
        bits = np.array([(code >> i) & 1 for i in range(len(open_))], float)
        miss = (abs(((bits - chance[open_]) * words[open_]).sum()), abs((bits - chance[open_]).sum()), code)
        if best is None or miss < best[0]:
            best = miss, bits
    done[open_] = best[1]
    return done


def _level(open_rows: DataFrame, level: int, last: bool) -> DataFrame:
    """One walk over blocks of the undecided rows."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what stays open for the landing is small then.
        block = block.sort_values(["size", "_coin", "doc_id"], ascending=[False, True, True], kind="stable")
        keys = block["_coin"].to_numpy().astype(np.int64).view(np.uint64) + U64(level + 1)
        coins = (mix(keys) >> U64(11)).astype(float) / float(1 << 53)
        chance = walk(block["_chance"].to_numpy(float), block["size"].to_numpy(), coins)
        if last:
            chance = land(chance, block["size"].to_numpy())
        return block.assign(_chance=chance)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("_open") / BLOCK)) if not last else F.lit(1)
    placed = open_rows.withColumn("_block", F.pmod(F.xxhash64("_coin", F.lit(level)), blocks))
    return placed.groupBy("source", "_block").applyInPandas(run, placed.schema)


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``."""
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "source", word_count().alias("size"))
    folder = fresh_path(spark, "mix")
    narrow.write.parquet(f"{folder}/sizes")
    narrow = spark.read.schema(narrow.schema).parquet(f"{folder}/sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    planned = targets(sources, weights, budget, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-12)
    planned = planned.withColumns({"_whole": whole.cast("long"), "_chance": F.greatest(rate - whole, F.lit(0.0))})
    planned.write.parquet(f"{folder}/plan")
    planned = spark.read.schema(planned.schema).parquet(f"{folder}/plan")
    largest = planned.agg(F.max("source_rows")).first()[0] or 0

    rows = narrow.join(
        planned.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", "_whole", "_chance",
        F.xxhash64("doc_id", "size").alias("_coin"),
        F.col("source_rows").alias("_open"),
    )
    decided, level, left = [], 0, largest
    while True:
        last = left <= BLOCK
        walked = _level(rows, level, last)
        walked.write.parquet(f"{folder}/level{level}")
        walked = spark.read.schema(walked.schema).parquet(f"{folder}/level{level}")
        is_open = (F.col("_chance") > 0) & (F.col("_chance") < 1)
        decided.append(walked.where(~is_open))
        if last:
            break
        # Two rows per block stay open at most.
        left = 2 * -(-left // BLOCK)
        rows = walked.where(is_open).drop("_block").withColumn("_open", F.ceil(F.col("_open") / BLOCK) * 2)
        level += 1
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    copies = F.col("_whole") + F.col("_chance").cast("long")
    return result.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows that share id, source and size deal their
    copies out among themselves."""
    keys = [f"_{k}" for k in MATCH]
    totals = mixed.groupBy(*MATCH).agg(F.sum("copies"), F.count(F.lit(1))).toDF(*keys, "_copies", "_rows")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source", word_count().alias("size"))
    same = [rows[k].eqNullSafe(totals[f"_{k}"]) for k in MATCH]
    joined = rows.join(totals, [same[0], same[1], same[2]])
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("row"))
    repeated = joined.where("_rows > 1").withColumn("_at", F.row_number().over(order))
    single = joined.where("_rows = 1").withColumn("_at", F.lit(1))
    own = F.expr("cast(_copies div _rows + if(_at <= _copies % _rows, 1, 0) as int)")
    taken = single.unionByName(repeated).withColumn("_own", own).where("_own > 0")
    return taken.withColumn("_own", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(
        *[F.col("row")[c].alias(c) for c in docs.columns]
    )
