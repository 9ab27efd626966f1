"""Words of byte blocks as 64-bit names and as strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from feedlake.llm.textblocks import U64, Block, mix

_GOLDEN = U64(0x9E3779B97F4A7C15)


def gaps(*codes: int | str) -> np.ndarray:
    """Byte table that is true at the given codes and characters."""
    table = np.zeros(256, bool)
    table[[c if isinstance(c, int) else ord(c) for c in codes]] = True
    return table


def names_of(block: Block, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, attempt: int = 0) -> np.ndarray:
    """64-bit names of (group, word); the words are hashed under another byte code at every attempt."""
    if attempt:
        codes = np.random.default_rng(attempt).permutation(256).astype(np.uint8)
        block = Block(codes[block.data], block.bounds)
    return mix(Block.span_hashes(block.prefix_hashes(), starts, ends) + mix(group.view(U64)) * _GOLDEN)


def texts_of(block: Block, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    data = np.ascontiguousarray(block.data[at])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def heads_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are sorted alike."""
    turn = np.zeros(len(sorted_columns[0]), bool)
    turn[:1] = True
    for column in sorted_columns:
        turn[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(turn)

