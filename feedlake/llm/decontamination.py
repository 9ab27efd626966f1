"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are short, documents are long, so Jaccard similarity says nothing; the measure is containment, the
share of an item's distinct five-word shingles that the document has. Items are partitioned by the
number of their shingles, up to the next power of two. Every partition has its own signature length: the
k smallest hash values of an item's shingles, with k large enough that an item of up to n shingles that is
contained to 0.75 must share at least one of them (k = n // 4 + 1: more shingles than may be missing). Documents are probed shingle by shingle against
these values, so no true containment is lost, whatever the document's length. Candidates are then
verified on the words of all shingles.

Words are runs outside space and \\x09-\\x0D, lower-cased. An item of fewer than five words has its whole
sequence as the one shingle and is found only in documents that are that sequence.

Everything is DataFrame operations. The signature table is broadcast only if its counted rows stay under
``BROADCAST_ROWS``; otherwise the planner joins by shuffle.

Defined results: null and empty texts contain nothing and are contained in nothing; repeated rows are
found once per id; repeated items are found under each of their ids; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import fresh_path

SHINGLE = 5
CONTAINMENT = 75
BROADCAST_ROWS = 500_000
_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: str = "text"):
    """Lower-cased words of a text; empty for null."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(low, _GAP), "")


def shingles(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and one row per shingle place: its words ``w1`` to ``w5`` (null beyond a short text's end)
    and their hash ``h``. Generated row by row, without holding a text's shingles in memory."""
    rows = df.select(*keep, words_of().alias("_words"))
    placed = rows.select(*keep, "_words", F.posexplode("_words").alias("_at", "w1"))
    count = F.size("_words")
    placed = placed.where((F.col("_at") + SHINGLE <= count) | ((F.col("_at") == 0) & (count < SHINGLE)))
    others = [F.get("_words", F.col("_at") + step).alias(f"w{step + 1}") for step in range(1, SHINGLE)]
    return placed.select(*keep, "w1", *others).withColumn("h", F.xxhash64(*_WORDS))


_WORDS = [f"w{i}" for i in range(1, SHINGLE + 1)]


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, the distinct shingles of the item, their number ``n`` and the size partition."""
    rows = shingles(items.where("item_id is not null").select("item_id", "text"), ["item_id"]).distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "item_id").withColumn("part", F.ceil(F.log2("n")).cast("int"))


def signature(rows: DataFrame) -> DataFrame:
    """The smallest hash values of each item: as many as the largest size of its partition asks for."""
    longest = F.expr("shiftleft(1, part) div 4 + 1").cast("int")
    smallest = rows.groupBy("item_id", "part", "n").agg(F.array_sort(F.collect_set("h")).alias("_hashes"))
    return smallest.select("item_id", "part", F.explode(F.slice("_hashes", F.lit(1), longest)).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, containment: int = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every item that a document contains."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "leaks")
    listed = item_shingles(items)
    listed.write.parquet(f"{folder}/items")
    listed = spark.read.schema(listed.schema).parquet(f"{folder}/items")
    probes = signature(listed).select("h", "item_id")
    small = probes.count() <= BROADCAST_ROWS

    texts = docs.where("doc_id is not null").select("doc_id", "text")
    probed = shingles(texts, ["doc_id"]).select("doc_id", "h")
    hit = probed.join(F.broadcast(probes) if small else probes, "h")
    pairs = hit.select("doc_id", "item_id").distinct()
    pairs.write.parquet(f"{folder}/candidates")
    pairs = spark.read.schema(pairs.schema).parquet(f"{folder}/candidates")

    # Exact containment on the words of the candidates' documents.
    suspects = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = listed.select("item_id", "n", *_WORDS, "h").join(pairs, "item_id")
    places = shingles(suspects, ["doc_id"])
    same = [places["doc_id"] == asked["doc_id"], places["h"] == asked["h"]]
    same += [places[w].eqNullSafe(asked[w]) for w in _WORDS]
    found = asked.join(places, same, "left_semi")
    shared = found.groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n") * containment).select(
        "doc_id", "item_id", F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows without an id stay."""
    bad = leaks(docs, items).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == F.col("_bad"), "left_anti")
