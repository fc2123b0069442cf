"""Whole Arrow string columns as one byte buffer: words, hashes and rolling hashes in numpy.

Batches are worked on in groups of rows of at most GROUP_BYTES (row_groups), a longer text being a
group of its own; hashes are made in chunks of CHUNK bytes. So temporary memory is some twenty times
the larger of GROUP_BYTES and the longest text, however many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK = 1 << 20
GROUP_BYTES = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have, step = 1, np.uint64(base)
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
        step = step * step
    return out


with np.errstate(over="ignore"):
    POW = _powers(int(BASE), CHUNK + 256)
    INV = _powers(pow(int(BASE), -1, 1 << 64), CHUNK + 256)
    TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def row_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column, in order, of at most `limit` bytes each or one row."""
    edges = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + limit, "right")) - 1)
        yield column.slice(at, stop - at)
        at = stop


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. offsets has one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`; a word never crosses two texts."""
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0] = after[-1] = False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edge = offsets[1:-1]
        before[edge[edge < len(data)]] = False
        after[edge[edge > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; starts ascend and spans don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(pow(int(BASE), CHUNK, 1 << 64))
        scale, carry = np.uint64(1), np.uint64(0)
        low = np.zeros(len(starts), np.uint64)
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = carry
            np.cumsum(TABLE[part] * (POW[: len(part)] * scale), out=sums[1:])
            sums[1:] += carry
            a, b = np.searchsorted(starts, [at, at + len(part)])
            low[a:b] = sums[starts[a:b] - at]
            a, b = np.searchsorted(ends, [at + 1, at + len(part) + 1])
            out[a:b] = sums[ends[a:b] - at]
            carry, scale = sums[-1], scale * base
        out -= low
        # shift to the word's own origin: times BASE^-start
        turn, origin = divmod(starts, CHUNK)
        steps = _powers(pow(int(BASE), -CHUNK, 1 << 64), int(turn[-1]) + 1 if len(turn) else 1)
        out *= INV[origin] * steps[turn]
        return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes (order counts); empty where there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for i in range(1, size):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : n + i])
    return h
