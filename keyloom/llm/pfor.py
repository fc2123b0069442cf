"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents:

    magic "PFB1" | n_docs, n_ids, n_blocks (uint64) | doc_ids (int64) | lengths (int64)
    | block starts, n_blocks + 1 (uint64, from the first block) | blocks

A block holds 128 ids: minimum (uint32), width (uint8), number of exceptions (uint8), the low
`width` bits of id - minimum for all 128 (vertical: 32-bit lanes), then the exceptions: their
places (uint8) and whole differences (uint32). The width is that of the percentile `share` of
the block's differences, so a few large ids don't widen it. The last block is filled up with
its last id. Block starts make every block addressable on its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import store
from keyloom.llm.tokens import lent, resolve

BLOCK = 128
MAGIC = b"PFB1"
HEAD = 6
SEGMENT_IDS = 1 << 20


def _widths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(lanes: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values under 2**width to (blocks, 16 * width) bytes."""
    out = np.zeros((4 * width, len(lanes)), np.uint32)
    cols = np.ascontiguousarray(lanes.T)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 32)
        out[word] |= cols[i] << np.uint32(bit)
        if bit + width > 32:
            out[word + 1] |= cols[i] >> np.uint32(32 - bit)
    return np.ascontiguousarray(out.T).view(np.uint8)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view(np.uint32).T)
    out = np.empty((BLOCK, len(raw)), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 32)
        got = words[word] >> np.uint32(bit)
        if bit + width > 32:
            got = got | (words[word + 1] << np.uint32(32 - bit))
        out[i] = got & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, bytes of all blocks) of uint32 ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, np.uint64), np.empty(0, np.uint8)
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    bits = _widths(diff)
    k = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    width = np.partition(bits, k, axis=1)[:, k]
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    sizes = HEAD + 16 * width.astype(np.int64) + 5 * n_over
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)
    head = np.empty((n, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4")[:, None].view(np.uint8)
    head[:, 4], head[:, 5] = width, n_over
    out[starts[:-1, None] + np.arange(HEAD)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            mask = np.uint32((1 << int(w)) - 1)
            out[starts[rows, None] + HEAD + np.arange(16 * int(w))] = _pack(diff[rows] & mask, int(w))
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        at = starts[row] + HEAD + 16 * width[row].astype(np.int64)
        out[at + nth] = place
        values = diff[row, place].astype("<u4")[:, None].view(np.uint8)
        out[(at + n_over[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return starts.astype(np.uint64), out


def decode_blocks(starts: np.ndarray, raw: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(starts) - 1
    if not n:
        return np.empty(0, np.uint32)
    at = starts[:-1].astype(np.int64)
    head = raw[at[:, None] + np.arange(HEAD)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, n_over = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            diff[rows] = _unpack(raw[at[rows, None] + HEAD + np.arange(16 * w)], int(w))
    row = np.repeat(np.arange(n), n_over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        tail = at[row] + HEAD + 16 * width[row]
        value = np.ascontiguousarray(raw[(tail + n_over[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        diff[row, raw[tail + nth]] = value
    return (diff + low[:, None]).reshape(-1)[:n_ids]


def encode_segment(doc_ids: list[int | None], ids: list[bytes], share: float = 0.9) -> bytes:
    """The length of a document without a key is written as its complement, so that no key stands for none."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts, blocks = encode_blocks(flat, share)
    lengths = np.array([len(x) // 4 if k is not None else ~(len(x) // 4) for k, x in zip(doc_ids, ids, strict=True)], "<i8")
    keys = np.array([0 if k is None else k for k in doc_ids], "<i8")
    return b"".join((MAGIC, struct.pack("<QQQ", len(doc_ids), len(flat), len(starts) - 1), keys.tobytes(), lengths.tobytes(), starts.astype("<u8").tobytes(), blocks.tobytes()))


def decode_segment(payload: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """(doc_ids, masked where there is none, lengths, ids)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of patched frame-of-reference blocks")
    n_docs, n_ids, n_blocks = struct.unpack_from("<QQQ", payload, 4)
    at = 28
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    lengths = np.frombuffer(payload, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, at)
    return np.ma.array(doc_ids, mask=lengths < 0), np.where(lengths < 0, ~lengths, lengths), decode_blocks(starts, np.frombuffer(payload, np.uint8, offset=at + 8 * (n_blocks + 1)), n_ids)


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, without touching the others."""
    n_docs, n_ids, n_blocks = struct.unpack_from("<QQQ", payload, 4)
    at = 28 + 16 * n_docs
    a, b = np.frombuffer(payload, "<u8", 2, at + 8 * block)
    raw = np.frombuffer(payload, np.uint8, offset=at + 8 * (n_blocks + 1))[int(a) : int(b)]
    return decode_blocks(np.array([0, b - a], np.uint64), raw, min(BLOCK, n_ids - block * BLOCK))


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, key: str = "doc_id", text: str = "text", share: float = 0.9) -> None:
    """Write segments, in ascending order of key, as a Parquet table (shard, segment, n_ids, payload).

    A shard is one range of keys; a task sorts its range and streams it, so memory holds a
    segment of about a million ids, or one document if that is longer. Null text: only the end
    id. Rows with equal keys stay apart, ordered by text; a null key sorts first and stays null.
    """
    model = resolve(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        shard, segment = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([segment], pa.int64()), pa.array([size], pa.int64()), pa.array([encode_segment(keys, ids, share)], pa.binary())], names=["shard", "segment", "n_ids", "payload"])

        with lent(model) as known:
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys.append(k)
                    ids.append(known.encode(x or "") + end)
                    size += len(ids[-1]) // 4
                    if size >= SEGMENT_IDS:
                        yield flush()
                        segment, keys, ids, size = segment + 1, [], [], 0
        if keys:
            yield flush()

    ordered = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)
    ordered.mapInArrow(run, "shard long, segment long, n_ids long, payload binary").write.parquet(path)


def read_tokens(spark, path: str, digest: bool = True) -> DataFrame:
    """One row for each document: doc_id, start (ids before it), n_tokens and their crc32 (or the ids themselves)."""
    segments = spark.read.parquet(path)
    per_shard = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    in_shard = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    starts = segments.select("shard", "segment", in_shard.alias("segment_start"), "n_ids").join(before, "shard").select("shard", "segment", (F.col("segment_start") + F.col("shard_start")).alias("start"))
    name, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = decode_segment(payload.as_buffer().to_pybytes())
                cut = np.concatenate(([0], np.cumsum(lengths)))
                raw = ids.astype("<u4")
                per = [zlib.crc32(raw[a:b]) if digest else raw[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids.data, pa.int64(), mask=doc_ids.mask), pa.array(start + cut[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(per, kind)], names=["doc_id", "start", "n_tokens", name])

    # one row for a million ids is sent to all tasks, so that payloads stay where they are read
    joined = segments.select("shard", "segment", "payload").join(F.broadcast(starts), ["shard", "segment"]).select("start", "payload")
    return joined.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'array<long>'}")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write docs' ids to a new table in the shared folder and read them back."""
    spark = docs.sparkSession
    path = store.new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    store.release(spark)  # the texts' shuffle, before the table is read
    return read_tokens(spark, path)
