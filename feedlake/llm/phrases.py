"""Phrase collocations from depth-truncated suffix subtrees (vertical partitioning as in ERA).

Texts (A-Z lower-cased) are cut into pieces and words; every word starts a suffix of at most ``DEPTH``
words that ends with its piece. Words that occur less than ``LEAST`` times cannot be part of a candidate, so a
suffix also ends before such a word. Which words are frequent comes from an exact count per language, as a
bitmap of bounded size; what passes it by mistake is only counted without use.

Vertical partitioning: the first pass also counts how many suffixes begin with each two-word prefix, by
``CELLS`` hashed cells, all of them counted. Cells are put together into groups of at most ``BUDGET`` suffixes;
a cell that is larger on its own is extended by the third word over as many groups as it needs. Each
group is one task's work and fits its memory: it sorts its suffixes into the leaves of its subtrees, adds
up their counts, and reads the counts of inner nodes from the leaf totals below them. Nodes of extended
cells lie in several groups and are summed once more. Before the shuffle each task folds equal suffixes
of half a million words, so a suffix that fills a third of all texts is a handful of rows.

Score of a candidate (2 to 3 words, a = count of at least ``LEAST``): the lowest
floor(1000000 * a * a / (l * r)) over its cuts, exact in decimals of 38 digits. A candidate goes if it stands
inside a longer candidate with at least half its count.

Words are named by 64-bit hashes of language and word; that no two words share a name is checked on the
whole vocabulary, and the names are drawn anew if they do.

Defined results: a null text is empty, a null language is ``und`` (together with that language itself);
repeated rows count each; languages without candidates return nothing; doc_id and other columns are not used.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.repeats import bitmap
from feedlake.llm.textblocks import U64, blocks, mix
from feedlake.llm.words import gaps, heads_of, names_of, texts_of
from feedlake.session import fresh_path

LEAST, TOP, DEPTH = 10, 2000, 3
BREAKS = gaps(*".,;:!?", 10, 11, 12, 13)
GAPS = BREAKS | gaps(9, 32)
CELLS = 1 << 16
BUDGET = 1 << 18
FOLD = 1 << 19
#: Per cent of a candidate's count that a longer one needs to cover it.
COVERED = 50
#: Exact: products have up to 38 digits.
SCORE = "(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * a) div (cast({l} as decimal(38,0)) * {r})"
_GOLDEN = U64(0x9E3779B97F4A7C15)


def _pieces(batch: pa.RecordBatch, attempt: int):
    """Per block: the lowered block, word starts and ends, row numbers of the batch, names, and whether the
    next word continues the piece."""
    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    for at, to, block in blocks(column["text"]):
        low = block.lowered()
        starts, ends = low.words(GAPS)
        owner = low.owner(starts)
        group = column["lang_key"].slice(at, to - at).to_numpy()[owner]
        names = names_of(low, starts, ends, group, attempt)
        broken = np.concatenate([[0], np.cumsum(BREAKS[low.data])])
        goes_on = np.zeros(len(starts), bool)
        if len(starts) > 1:
            goes_on[:-1] = (owner[1:] == owner[:-1]) & (broken[starts[1:]] == broken[ends[:-1]])
        yield low, starts, ends, owner + at, names, goes_on


def _cell(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first + second * _GOLDEN) >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counted(texts: DataFrame, attempt: int) -> DataFrame:
    """Rows (lang, word, name, n) of words, and (null, null, cell, n) of the suffixes in each prefix cell."""

    def work(batches):
        loads = np.zeros(CELLS, np.int64)
        names = ["lang", "word", "name", "n"]
        for batch in batches:
            lang = batch.column(batch.schema.get_field_index("lang"))
            for low, starts, ends, owner, name, goes_on in _pieces(batch, attempt):
                on = np.flatnonzero(goes_on)
                loads += np.bincount(_cell(name[on], name[on + 1]), minlength=CELLS)
                distinct, first, n = np.unique(name, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.take(pa.array(owner[first])).cast(pa.string()),
                        texts_of(low, starts[first], ends[first]),
                        pa.array(distinct.view(np.int64)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=names,
                )
        cell = np.flatnonzero(loads)
        none = pa.nulls(len(cell), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(cell), pa.array(loads[cell])], names=names)

    return texts.mapInArrow(work, "lang string, word string, name long, n long")


def vocabulary(texts: DataFrame, stored) -> tuple[DataFrame, np.ndarray, int]:
    """All words with their counts and names, the loads of the prefix cells, and the attempt that gave
    every word a name of its own."""
    for attempt in count():
        counted = _counted(texts, attempt).groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))
        counted = stored(counted, f"words-{attempt}")
        words = counted.where("word is not null")
        shared = words.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or name = 0")
        if shared.isEmpty():
            break
    loads = np.zeros(CELLS, np.int64)
    for row in counted.where("word is null").collect():  # at most CELLS rows
        loads[row["name"]] = row["n"]
    return words, loads, attempt


def pack(loads: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every cell. Neighbouring cells share a group as long as they
    fit the budget; a cell above it has groups of its own."""
    first, parts = np.zeros(len(loads), np.int64), np.ones(len(loads), np.int64)
    group, room = 0, budget
    for cell, load in enumerate(loads.tolist()):
        if load > budget:
            parts[cell] = -(-load // budget)
            group, room = group + (room < budget), budget
            first[cell] = group
            group += int(parts[cell])
        else:
            if load > room:
                group, room = group + 1, budget
            first[cell] = group
            room -= load
    return first, parts


def _fold(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct suffixes with their counts, in order: rows that begin alike lie together and pack well."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    heads = heads_of(*columns)
    return *(c[heads] for c in columns), np.diff(np.append(heads, len(order)))


def suffixes(texts: DataFrame, words: DataFrame, loads: np.ndarray, attempt: int) -> DataFrame:
    """Rows (part, split, w1, w2, w3, n): truncated suffixes of two or three frequent words (w3 = 0: two)."""
    share = texts.sparkSession.sparkContext.broadcast
    frequent = share(bitmap(words.where(F.col("n") >= LEAST).select("name"), "name"))
    plan = share(pack(loads, BUDGET))

    def work(batches):
        first, parts = plan.value
        held, size = [], 0

        def rows():
            w1, w2, w3, n = _fold(held)
            cell = _cell(w1, w2)
            group = first[cell] + (mix(w3) % parts[cell].astype(U64)).astype(np.int64)
            columns = [group.astype(np.int32), parts[cell] > 1, w1.view(np.int64), w2.view(np.int64), w3.view(np.int64), n.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "split", "w1", "w2", "w3", "n"])

        for batch in batches:
            for _, _, _, _, name, goes_on in _pieces(batch, attempt):
                known = frequent.value.has(name)
                pair = np.zeros(len(name), bool)
                pair[:-1] = known[:-1] & goes_on[:-1] & known[1:]
                at = np.flatnonzero(pair)
                third = np.zeros(len(at), U64)
                longer = pair[at + 1]
                third[longer] = name[at[longer] + 2]
                held.append((name[at], name[at + 1], third))
                size += len(at)
                if size >= FOLD:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    return texts.mapInArrow(work, "part int, split boolean, w1 long, w2 long, w3 long, n long")


def subtree(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (w1, w2, w3, count) and two-word nodes (w1, w2, count) of one group's suffixes (4 columns)."""
    ordered = suffix[:, np.lexsort(suffix[2::-1])]
    heads = heads_of(*ordered[:3])
    leaves = np.vstack([ordered[:3, heads], np.add.reduceat(ordered[3], heads)])
    heads = heads_of(*leaves[:2])
    return leaves[:, leaves[2] != 0], np.vstack([leaves[:2, heads], np.add.reduceat(leaves[3], heads)])


def node_counts(rows: DataFrame, least: int) -> DataFrame:
    """(w1, w2, w3, n, split) of the nodes of two (w3 = 0) and three words that occur ``least`` times. Two-word
    nodes of extended cells come as ``split`` parts, of any count."""

    def grow(group: pa.Table) -> pa.Table:
        suffix = np.vstack([group.column(c).to_numpy() for c in ("w1", "w2", "w3", "n")])
        split = group.column("split")[0].as_py()
        leaves, inner = subtree(suffix)
        leaves = leaves[:, leaves[3] >= least]
        if not split:
            inner = inner[:, inner[2] >= least]
        inner = np.vstack([inner[:2], np.zeros((1, inner.shape[1]), np.int64), inner[2:]])
        both = np.hstack([leaves, inner])
        columns = [pa.array(c) for c in both] + [pa.array((both[2] == 0) & split)]
        return pa.table(columns, names=["w1", "w2", "w3", "n", "split"])

    return rows.groupBy("part").applyInArrow(grow, "w1 long, w2 long, w3 long, n long, split boolean")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "phrases")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), docs["text"].alias("text"))
    words, loads, attempt = vocabulary(texts, stored)
    grown = stored(node_counts(suffixes(texts, words, loads, attempt), LEAST), "nodes")
    whole = grown.where("w3 = 0 and not split").select("w1", "w2", "n")
    merged = grown.where("split").groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    pairs = stored(whole.unionByName(merged), "pairs")
    triples = grown.where("w3 != 0").select("w1", "w2", "w3", "n")

    known = words.where(F.col("n") >= LEAST)

    def word(k: int) -> DataFrame:
        return known.select(
            F.col("name").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias(f"f{k}"), F.col("lang").alias(f"lang{k}")
        )

    first = pairs.withColumnRenamed("n", "a").join(word(1), "w1").join(word(2), "w2")
    twos = first.select("w1", "w2", F.col("lang1").alias("lang"), F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", "f1", "f2")
    twos = twos.select("*", F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", F.expr(SCORE.format(l="l", r="r")))
    halves = triples.select("w1", "w2", "n").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
    longer = halves.groupBy("w1", "w2").agg(F.max("n").alias("longer"))
    twos = twos.join(longer, ["w1", "w2"], "left").where(f"longer is null or 100 * longer < {COVERED} * a")

    begin = pairs.withColumnRenamed("n", "f12")
    end = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("f23"))
    threes = triples.withColumnRenamed("n", "a").join(begin, ["w1", "w2"]).join(end, ["w2", "w3"])
    threes = threes.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    threes = threes.withColumns({"s1": F.expr(SCORE.format(l="f1", r="f23")), "s2": F.expr(SCORE.format(l="f12", r="f3"))})
    early = F.col("s1") <= F.col("s2")
    threes = threes.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = twos.select(*threes.columns).unionByName(threes).withColumn("rank", F.row_number().over(best).cast("long"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = ranked.where(F.col("rank") <= top).join(totals, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
