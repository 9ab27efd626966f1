"""Exact repeats of long byte strings: window fingerprints at content-chosen anchors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else, in the same text or
in another one. Matches never cross texts and all strings are judged on the input.

This stands in place of prefix doubling, which sorts pairs of ranks at doubled offsets: here no ranks are
combined, each round fingerprints its whole span from the text. As there, a position is dropped once its
span is unique. Ranking every byte position would move many times the input (an estimate; the doubling form
was not run). Nothing is lost: each window of ``LENGTH`` bytes belongs to its anchor, the position with the smallest gram hash
among its first ``SPAN + 1``. Equal windows have the same anchor at the same offset, wherever they stand, and
there is one anchor for some 45 bytes. Ranks are 64-bit fingerprints of the strings: only their
equality matters here. The rounds, each a count per rank, sorted and merged by Spark:

1. anchors by the ``SPAN`` bytes behind them (part of every window of the anchor); unique ones end here,
2. anchors by the whole stretch of their windows; where a stretch occurs again all its windows do,
3. of the others, cells of ``CELL`` neighbouring windows, in the same way,
4. of the cells still open, the single windows.

Rounds 3 and 4 rank the open ones and one representative of every repeated stretch that shares their
prefix, so groups of copies are not ranked again. Which positions a round has to look at comes as a Bloom
bitmap of at most ``MAX_BITS`` bits (its size is bounded whatever the input); a false positive only ranks
one position more, and ranks that turn out unique are recorded, by text, as exceptions. The last pass
over the texts finds everything that passed the bitmaps and is no exception.

Defined results: null and empty texts and those shorter than ``LENGTH`` keep all bytes; repeated rows are
repeats of each other; other columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.textblocks import U64, Block, blocks, map_blocks, mix
from feedlake.session import fresh_path

LENGTH, SPAN, GRAM, CELL = 200, 100, 8, 16
MIN_BITS, MAX_BITS, BITS_PER_KEY = 20, 28, 16
_SLICE = 1 << 15
_GOLDEN = U64(0x9E3779B97F4A7C15)


class Anchors:
    """Anchors of a block with the range of windows (first, last start) that belong to each."""

    def __init__(self, block: Block, rows: np.ndarray | None = None):
        data, bounds = block.data, block.bounds
        self.prefix = block.prefix_hashes()
        starts = max(len(data) - LENGTH + 1, 0)
        if starts == 0:
            self.at = self.first = self.last = self.base = np.zeros(0, np.int64)
            self.row = np.zeros(0, U64)
            return
        windows = np.arange(starts)
        stop = np.repeat(bounds[1:], np.diff(bounds))[:starts]
        windows = windows[windows + LENGTH <= stop]
        grams = np.arange(len(data) - GRAM + 1)
        # Hash above, position below: the minimum is the leftmost of the smallest hash.
        least = (self.span(grams, grams + GRAM) >> U64(32) << U64(32)) | grams.astype(U64)
        width = 1
        while 2 * width <= SPAN + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        anchor = (least[windows] & U64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(windows, prepend=-9) != 1))
        self.at, self.first = anchor[head], windows[head]
        self.last = windows[np.append(head[1:], len(windows)) - 1] if len(head) else windows[:0]
        # The row key of each anchor's text, to make names of places.
        self.row = rows[block.owner(self.at)] if rows is not None else np.zeros(len(head), U64)
        self.base = bounds[block.owner(self.at)]

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return Block.span_hashes(self.prefix, a, b)

    def keep(self, chosen: np.ndarray) -> Anchors:
        for name in ("at", "first", "last", "row", "base"):
            setattr(self, name, getattr(self, name)[chosen])
        return self

    def prefixes(self) -> np.ndarray:
        return self.span(self.at, self.at + SPAN)

    def stretches(self) -> np.ndarray:
        """Ranks of the whole stretch of windows, with its place about the anchor."""
        return mix(self.span(self.first, self.last + LENGTH) + (self.at - self.first).astype(U64) * _GOLDEN)

    def places(self) -> np.ndarray:
        """Names of the anchors themselves."""
        return mix(self.row + (self.at - self.base).astype(U64) * _GOLDEN)


class Cells:
    """Cells of windows of anchors: those whose offset to the anchor has the same quotient by CELL."""

    def __init__(self, anchors: Anchors):
        near, far = anchors.at - anchors.last, anchors.at - anchors.first
        lowest = near // CELL
        count = far // CELL - lowest + 1
        which = np.repeat(np.arange(len(near)), count)
        cell = lowest[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = anchors.at[which]
        low, high = np.maximum(near[which], cell * CELL), np.minimum(far[which], cell * CELL + CELL - 1)
        self.which, self.first, self.last = which, at - high, at - low
        self.core = mix(anchors.span(at - cell * CELL, at - cell * CELL - CELL + 1 + LENGTH) + cell.astype(U64) * _GOLDEN)
        self.stretch = mix(anchors.span(self.first, self.last + LENGTH) + (low * 512 + high).astype(U64) * _GOLDEN)
        self.row, self.base = anchors.row[which], anchors.base[which]
        self.place = mix(anchors.places()[which] + (cell + 1).astype(U64))

    def keep(self, chosen: np.ndarray) -> Cells:
        for name in ("which", "first", "last", "core", "stretch", "row", "base", "place"):
            setattr(self, name, getattr(self, name)[chosen])
        return self

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows of the cells, their row keys and their names as places."""
        count = self.last - self.first + 1
        which = np.repeat(np.arange(len(count)), count)
        start = self.first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        place = mix(self.row[which] + (start - self.base[which]).astype(U64) * _GOLDEN + U64(1 << 63))
        return start, self.row[which], place


class Bitmap:
    """Fixed-size one-hash Bloom filter over 64-bit keys."""

    def __init__(self, raw: np.ndarray, bits: int):
        self.raw, self.bits = raw, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & U64((1 << self.bits) - 1)
        return (self.raw[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def bitmap(keys: DataFrame, column: str) -> Bitmap:
    """Bitmap of a column of longs; what comes to the driver is at most 2^MAX_BITS / 8 bytes."""
    count = keys.count()
    bits = int(np.clip(int(max(count, 1) * BITS_PER_KEY).bit_length(), MIN_BITS, MAX_BITS))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    slices = keys.select(F.shiftright(at, 15).alias("slice"), at.bitwiseAND(F.lit(_SLICE - 1)).alias("bit"))
    raw = np.zeros((1 << bits) // 8, np.uint8)
    for row in slices.groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("raw")).collect():
        part = np.frombuffer(row["raw"], np.uint8)
        raw[row["slice"] * _SLICE // 8 : row["slice"] * _SLICE // 8 + len(part)] = part
    return Bitmap(raw, bits)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _round(texts: DataFrame, ranked, stored, name: str) -> tuple[DataFrame, DataFrame]:
    """Count ranks. ``ranked(block, rows)`` gives (rank, prefix rank, row, place) arrays. Returns the stored
    counts and the exceptions (row, place) of unique ranks."""

    def emit(rows, block):
        rank, prefix, row, place = ranked(block, rows.column(0).to_numpy().view(U64))
        return {"rank": _signed(rank), "prefix": _signed(prefix), "row": _signed(row), "place": _signed(place)}

    emitted = map_blocks(texts, "rank long, prefix long, row long, place long", emit)
    counted = emitted.groupBy("rank", "prefix").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("row").alias("row"), F.min("place").alias("place")
    )
    counted = stored(counted, name)
    return counted, counted.where("n = 1").select("row", "place")


def _open_places(counted: DataFrame) -> DataFrame:
    """Places to rank further: prefixes that occur again and have a unique rank among their ranks; of a
    repeated rank one place stands for all."""
    mixed = counted.groupBy("prefix").agg(F.min("n").alias("least"), F.sum("n").alias("all"))
    mixed = mixed.where("least = 1 and all > 1").select("prefix")
    return counted.select("prefix", "place").join(mixed, "prefix", "left_semi").select("place")


def find_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and the runs (start, stop in
    bytes) of every row of ``docs``."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "repeats")
    share = spark.sparkContext.broadcast

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    whole = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("_row"), docs["text"].alias("text"))
    texts = whole.where(F.octet_length("text") >= LENGTH)

    def first_ranks(rows, block):
        keys, times = np.unique(Anchors(block).prefixes() & U64(0xFFFFFFFF), return_counts=True)
        return {"key": keys.astype(np.uint32).view(np.int32), "n": np.minimum(times, 2).astype(np.int32)}

    again = map_blocks(texts, "key int, n int", first_ranks).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    again = stored(again.select(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")), "prefixes")
    alive = share(bitmap(again, "key"))

    def anchors(block, rows):
        found = Anchors(block, rows)
        return found.keep(alive.value.has(found.prefixes() & U64(0xFFFFFFFF)))

    def anchor_ranks(block, rows):
        found = anchors(block, rows)
        return found.stretches(), found.prefixes(), found.row, found.places()

    counted, unique_anchors = _round(texts, anchor_ranks, stored, "anchors")
    open_anchors = share(bitmap(_open_places(counted), "place"))

    def cells(block, rows):
        found = anchors(block, rows)
        return Cells(found.keep(open_anchors.value.has(found.places())))

    def cell_ranks(block, rows):
        found = cells(block, rows)
        return found.stretch, found.core, found.row, found.place

    counted, unique_cells = _round(texts, cell_ranks, stored, "cells")
    open_cells = share(bitmap(_open_places(counted), "place"))

    def window_ranks(block, rows):
        found = cells(block, rows)
        found = found.keep(open_cells.value.has(found.place))
        start, row, place = found.windows()
        rank = Block.span_hashes(block.prefix_hashes(), start, start + LENGTH)
        return rank, np.zeros(len(rank), U64), row, place

    _, unique_windows = _round(texts, window_ranks, stored, "windows")
    exceptions = unique_anchors.unionByName(unique_cells).unionByName(unique_windows)
    listed = exceptions.groupBy("row").agg(F.collect_set("place").alias("_unique"))

    rows = docs.select(*keep, F.xxhash64(docs["doc_id"], docs["text"]).alias("_row"), "text")
    # Keys of listed texts are distinct, so no text meets more than one list.
    joined = rows.join(listed.withColumnRenamed("row", "_row"), "_row", "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)

    def repeated_windows(block, keys, unique):
        found = Anchors(block, keys)
        found.keep(alive.value.has(found.prefixes() & U64(0xFFFFFFFF)))
        single = np.isin(found.places(), unique)
        ranges = [(found.first[~single], found.last[~single])]
        found.keep(single)
        found.keep(open_anchors.value.has(found.places()))
        inner = Cells(found)
        single = np.isin(inner.place, unique)
        ranges.append((inner.first[~single], inner.last[~single]))
        inner.keep(single)
        inner.keep(open_cells.value.has(inner.place))
        start, _, place = inner.windows()
        start = start[~np.isin(place, unique)]
        ranges.append((start, start))
        return np.concatenate([r[0] for r in ranges]), np.concatenate([r[1] for r in ranges])

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            for at, to, block in blocks(batch.column(names.index("text"))):
                part = batch.slice(at, to - at)
                keys = part.column(names.index("_row")).to_numpy().view(U64)
                lists = part.column(names.index("_unique"))
                unique = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                first, last = repeated_windows(block, keys, unique)
                edge = np.zeros(len(block.data) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = {"n_bytes": np.diff(block.bounds), "n_removed": [], "n_spans": [], "kept_sha256": [], "runs": []}
                for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True):
                    mask = gone[a:b]
                    turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                    out["n_removed"].append(int(mask.sum()))
                    out["n_spans"].append(len(turns) // 2)
                    out["kept_sha256"].append(hashlib.sha256(block.data[a:b][~mask].tobytes()).hexdigest())
                    out["runs"].append([{"start": int(x), "stop": int(y)} for x, y in turns.reshape(-1, 2)])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(names.index(k)) for k in keep), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))],
                    names=[*keep, *out],
                )

    schema = f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<start:long,stop:long>>"
    return joined.select(*keep, "_row", "text", "_unique").mapInArrow(cut, schema)
