"""Whole texts as byte blocks inside Arrow batches, with word spans and 64-bit span hashes in numpy.

A block holds the UTF-8 bytes of some consecutive rows. Blocks are cut at about ``BLOCK_BYTES`` so that
the working memory of a task does not follow the batch size; one text longer than that is a block of
its own. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = np.asarray(values, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of them."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


@dataclass
class Block:
    """``data`` holds the texts one after the other; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Row number of the text that each byte position belongs to."""
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def words(self, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes outside ``gaps`` (space and \\x09-\\x0D if not given)."""
        inside = ~gaps[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if len(inside):
            heads = self.bounds[:-1][self.bounds[:-1] < len(inside)]
            first[heads] = inside[heads]
            tails = self.bounds[1:][self.bounds[1:] > 0] - 1
            last[tails] = inside[tails]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def prefix_hashes(self) -> np.ndarray:
        """Running polynomial hash, one entry more than bytes."""
        up, _ = _power_table(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], dtype=U64, out=sums[1:])
        return sums

    @staticmethod
    def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans of equal length hash alike wherever they stand."""
        _, down = _power_table(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))

    def lowered(self) -> Block:
        """The block with A-Z in lower case."""
        return Block(LOWER[self.data], self.bounds)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Cut a text column into (first row, row after the last, block)."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(texts))
        yield at, to, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def map_blocks(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch, Block], dict | None], text: str = "text"
) -> DataFrame:
    """Apply ``work(rows, block)`` to every block; it returns the output columns of that block."""

    def run(batches):
        names = None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for at, to, block in blocks(column):
                out = work(batch.slice(at, to - at), block)
                if out is not None:
                    names = names or list(out)
                    yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def per_row(counts_of: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum) per row number, as 64-bit integers."""
    return np.bincount(counts_of, weights, minlength=rows).astype(np.int64)


def distinct_per_row(owner: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct 64-bit keys per row."""
    if not len(keys):
        return np.zeros(rows, np.int64)
    _, first = np.unique(mix(keys + owner.astype(U64) * U64(_BASE)), return_index=True)
    return per_row(owner[first], rows)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows cut at every change of ``keys``; a run may cross batches."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table]).combine_chunks()
        if not table.num_rows:
            continue
        turn = np.zeros(table.num_rows, bool)
        for k in keys:
            turn[1:] |= np.diff(table.column(k).to_numpy()) != 0
        cuts = np.flatnonzero(turn)
        for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True) if len(cuts) else ():
            yield table.slice(a, b - a)
        carry = table.slice(cuts[-1] if len(cuts) else 0)
    if carry is not None and carry.num_rows:
        yield carry
