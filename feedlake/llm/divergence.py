"""Divergence of the term use of sources: pair tasks that merge sparse count arrays.

Terms are runs of letters (A-Z lower-cased, all characters beyond ASCII count as letters). A language keeps
the terms that stand in at least ``LEAST`` of its documents. Every group (language, source) and every
language gives each kept term a smoothed share p in units of 1 / ``SCALE``; all arithmetic is in integers.

Terms get ids, and each group's (term id, count) arrays, sorted by id, are cut into chunks of some ``CHUNK``
terms. The groups of a language are dealt to blocks of some ``BLOCK``; one task co-groups two blocks'
arrays of one chunk and merges each unordered pair of groups once: the shorter array gallops through
the longer one, terms of both are priced against each other, terms of one side against the other side's
share of an absent term, both ways. Terms that neither has are all alike, so they are only counted, and priced
when the chunks of a pair are added up. So no task holds a vocabulary or all sources of a language.

A first pass counts documents per hashed term, so that the second one moves counts of terms that can be kept
only; a shared hash lets a term through to the exact count and changes nothing.

Defined results: null text, language and source are empty strings; groups without kept terms take part,
and are told nothing but distances; in a language without kept terms all distances are 0; rows count as
documents, repeated or not; doc_id and other columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.repeats import bitmap
from feedlake.llm.textblocks import U64, blocks, mix
from feedlake.llm.words import heads_of, names_of, texts_of
from feedlake.session import fresh_path

LEAST, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
CHUNK, BLOCK = 1 << 16, 16
_GOLDEN = U64(0x9E3779B97F4A7C15)
#: Bytes that are no letters: ASCII but A-Z and a-z.
OTHER = np.array([not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])


def _terms(batch: pa.RecordBatch):
    """Per block: the lowered block, term starts and ends, row numbers of the batch, hashes of (language, term)."""
    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    for at, to, block in blocks(column["text"]):
        low = block.lowered()
        starts, ends = low.words(OTHER)
        owner = low.owner(starts) + at
        yield low, starts, ends, owner, names_of(low, starts, ends, column["lang_key"].to_numpy()[owner])


def _spread(texts: DataFrame) -> DataFrame:
    """(name, df): documents per hashed term, summed per block."""

    def work(batches):
        for batch in batches:
            for _, _, _, owner, name in _terms(batch):
                order = np.lexsort((name, owner))
                once = name[order][heads_of(owner[order], name[order])]
                distinct, df = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(df.astype(np.int64))], names=["name", "df"])

    return texts.mapInArrow(work, "name long, df long").groupBy("name").agg(F.sum("df").alias("df"))


def _counted(texts: DataFrame, possible) -> DataFrame:
    """(lang, source, term, n, df) of the terms whose hash is in the bitmap."""

    def work(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = column["group_key"].to_numpy().view(U64)
            for low, starts, ends, owner, name in _terms(batch):
                at = np.flatnonzero(possible.value.has(name))
                group, found, row = keys[owner[at]], name[at], owner[at]
                order = np.argsort(mix(found + group * _GOLDEN), kind="stable")  # rows stay in order
                group, found, row, at = group[order], found[order], row[order], at[order]
                heads = heads_of(group, found)
                docs = heads_of(group, found, row)
                n = np.diff(np.append(heads, len(at)))
                df = np.diff(np.append(np.searchsorted(docs, heads), len(docs)))
                first = at[heads]
                rows = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        column["lang"].take(rows).cast(pa.string()),
                        column["source"].take(rows).cast(pa.string()),
                        texts_of(low, starts[first], ends[first]),
                        pa.array(n.astype(np.int64)),
                        pa.array(df.astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )

    found = texts.mapInArrow(work, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)) by long division, three digits at a time, so that
    nothing passes 64 bits (n is part of total)."""
    under = total + SMOOTH * kept
    if under == 0:
        return np.zeros(len(n), np.int64)
    whole, rest = np.divmod(np.asarray(n, np.int64) + SMOOTH, under)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + more
    return whole + 1


def price(a, b) -> tuple[int, int]:
    """Sum of the differences over the terms that one side has at least, and the number of these terms. A
    side is (ids in order, shares, share of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    ids_a, p_a, none_a = a
    ids_b, p_b, none_b = b
    place = np.searchsorted(ids_b, ids_a)  # the shorter array gallops through the longer one
    both = np.zeros(len(ids_a), bool)
    inside = place < len(ids_b)
    both[inside] = ids_b[place[inside]] == ids_a[inside]
    alone = np.ones(len(ids_b), bool)
    alone[place[both]] = False
    value = np.abs(p_a[both] - p_b[place[both]]).sum() + np.abs(p_a[~both] - none_b).sum() + np.abs(p_b[alone] - none_a).sum()
    return int(value), len(ids_a) + int(alone.sum())


def _merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """All unordered pairs of sources between two blocks (within the block, if they are the same one)."""

    def sides(frame):
        out = []
        for r in frame.itertuples(index=False):
            ids, n = np.asarray(r.ids, np.int64), np.asarray(r.counts, np.int64)
            out.append((r.source, (ids, shares(n, r.total, r.kept), int(shares(np.zeros(1, np.int64), r.total, r.kept)[0]))))
        return out

    columns = ["lang", "a", "b", "value", "union"]
    if left.empty or right.empty:
        return pd.DataFrame(columns=columns)
    lang, same = left["lang"].iloc[0], left["i"].iloc[0] == left["j"].iloc[0]
    ours, theirs = sides(left), sides(right)
    rows = [(lang, x, y, *price(a, b)) for x, a in ours for y, b in theirs if not same or x < y]
    return pd.DataFrame(rows, columns=columns)


def _chunked(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group and chunk of its language, with sorted ``ids`` and their ``counts``; empty ones too."""
    chunks = F.greatest(F.ceil(F.col("kept") / CHUNK), F.lit(1)).cast("int")
    every = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    sizes = groups.groupBy("lang").agg(F.first("kept").alias("kept"))
    placed = kept.join(sizes, "lang").select("lang", "term", "id", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
    rows = counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"])
    arrays = rows.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("entries"))
    filled = every.join(arrays, ["lang", "source", "chunk"], "left")
    entry = F.coalesce("entries", F.array().cast("array<struct<id:bigint,n:bigint>>"))
    return filled.withColumns({"ids": entry["id"], "counts": entry["n"]}).drop("entries")


def pair_values(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every group to every other source of its language."""
    number = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    rows = chunks.join(number, "lang")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("source"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    tile, carried = ["lang", "chunk", "i", "j"], ["source", "ids", "counts", "total", "kept"]
    dealt = rows.withColumn("_other", other)
    left = dealt.where("_own <= _other").select("lang", "chunk", F.col("_own").alias("i"), F.col("_other").alias("j"), *carried)
    again = dealt.toDF(*dealt.columns)
    right = again.where("_other <= _own").select("lang", "chunk", F.col("_other").alias("i"), F.col("_own").alias("j"), *carried)
    merged = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(_merge, "lang string, a string, b string, value long, union long")
    summed = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("union").alias("union"))
    none = groups.select("lang", "source", "kept", share(F.lit(0), "total").alias("none"))
    for side in ("a", "b"):
        names = {"source": side, "none": f"none_{side}", "kept": f"kept_{side}"}
        summed = summed.join(none.withColumnsRenamed(names), ["lang", side])
    absent = (F.col("kept_a") - F.col("union")) * F.abs(F.col("none_a") - F.col("none_b"))
    summed = summed.withColumn("value", F.when(F.col("kept_a") > 0, F.col("value") + absent).otherwise(F.lit(0).cast("long")))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]))
    return summed.select("lang", "value", ways.alias("way")).select("lang", "way.*", "value")


def share(n: Column, total: str, kept: str = "kept") -> Column:
    """:func:`shares` as a column, in decimals of 38 digits; null where nothing is kept and counted."""
    wide = "decimal(38,0)"
    over = (n.cast("long") + SMOOTH).cast(wide) * F.lit(SCALE).cast(wide)
    under = F.nullif((F.col(total) + SMOOTH * F.col(kept)).cast(wide), F.lit(0).cast(wide))
    return F.call_function("div", over, under) + 1


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "divergence")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lang, source = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in ("lang", "source"))
    texts = docs.select(
        lang.alias("lang"), source.alias("source"), F.xxhash64(lang).alias("lang_key"),
        F.xxhash64(lang, source).alias("group_key"), docs["text"].alias("text"),
    )
    frequent = stored(_spread(texts).where(F.col("df") >= LEAST).select("name"), "names")
    counts = stored(_counted(texts, spark.sparkContext.broadcast(bitmap(frequent, "name"))), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= LEAST)
    kept = stored(kept.select("lang", "term", "all", F.monotonically_increasing_id().alias("id")), "terms")
    counts = stored(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "kept")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("all_total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "kept", "all_total"]), "groups")

    pairs = pair_values(stored(_chunked(counts, kept, groups), "chunks"), groups)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))

    terms = counts.join(kept.select("lang", "term", "all"), ["lang", "term"]).join(groups, ["lang", "source"])
    over = share(F.col("n"), "total") - share(F.col("all"), "all_total")
    terms = terms.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
