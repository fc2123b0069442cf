"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Only sampled suffixes are indexed. In every window of `length` bytes the smallest hash of an
ANCHOR-byte string (the leftmost of equals) is the window's anchor, so equal windows have equal
anchors at equal distances, and about one byte in 35 starts an indexed suffix. Neighbouring
windows with one anchor form a run; its context is all the bytes under the run.

A task takes its texts in batches. Each batch's sampled suffixes are sorted into an array
(in the order of 64-bit fingerprints of anchor and context, as only equality over `length`
bytes or more is asked), merge-scanned against the arrays of earlier levels, and kept as a new
level; levels of like size merge, so there are logarithmically many. An entry found twice keeps its earliest
place; the runs at other places are matches. What is left, at most one entry a task for any
context, is dealt out by anchor and merge-scanned once more over all tasks. Runs whose anchor
is shared by different contexts (the edges of copied passages) go a second time through the
same family, window by window.

Positions that start earlier: smaller doc_id, or the same document and an earlier start. Rows that
share a doc_id are documents of their own, in the order of their numbers (`nth`, see store.numbered).

Defined cases: null text is empty; a text shorter than `length` is never touched; of rows with
one doc_id, equal or not, one counts as the first and keeps its text; a null doc_id sorts
first. Extra columns are ignored or, in `clean_documents`, kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.llm import store
from keyloom.llm.bytetext import CHUNK, INV, POW, TABLE, column_bytes, mix
from keyloom.llm.workers import frugal

ANCHOR = 32
LENGTH = 100
ENTRY = np.dtype([("print", "u8"), ("anchor", "i8"), ("context", "i8"), ("doc", "i8"), ("nth", "i8"), ("at", "i8"), ("n", "i8")])
FOUND = "anchor long, context long, doc_id long, nth long, at long, n long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Prints:
    """Hashes of any stretch of one piece of bytes."""

    def __init__(self, part: np.ndarray) -> None:
        self.sums = np.empty(len(part) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(TABLE[part] * POW[: len(part)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(((self.sums[ends] - self.sums[starts]) * INV[starts]) ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))

    def every(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * INV[:n])


def entries(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, nth: np.ndarray, length: int) -> np.ndarray:
    """The runs of all texts of a batch: anchor, context, document, first window, windows."""
    out = []
    for p in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[p : p + CHUNK + length - 1]
        windows = len(part) - length + 1
        if windows <= 0:
            break
        prints = Prints(part)
        hashes = prints.every(ANCHOR)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min((hashes & np.uint64(0xFFFFFFFF00000000)) | places, length - ANCHOR + 1)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        whole = np.ones(windows, bool)
        a, b = np.searchsorted(offsets, [p + 1, p + len(part)])
        for edge in offsets[a:b]:
            whole[max(0, edge - length + 1 - p) : max(0, edge - p)] = False
        edges = np.concatenate(([0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])) + 1, [windows]))
        first, last = edges[:-1], edges[1:]
        good = whole[first]
        first, last = first[good], last[good]
        if not len(first):
            continue
        at = anchor[first]
        row = np.searchsorted(offsets, first + p, "right") - 1
        found = np.empty(len(first), ENTRY)
        found["anchor"] = hashes[at].view(np.int64)
        shape = ((at - first).astype(np.uint64) << np.uint64(20)) | (last - first).astype(np.uint64)
        context = prints.of(first, last - 1 + length)
        context = mix(context + mix(shape))
        found["context"] = context.view(np.int64)
        found["print"] = mix(hashes[at] ^ (context << np.uint64(1)))
        found["doc"], found["nth"], found["at"] = docs[row], nth[row], first + p - offsets[row]
        found["n"] = last - first
        out.append(found)
    return np.concatenate(out) if out else np.empty(0, ENTRY)


class SuffixLevels:
    """The logarithmic family. add() takes a batch's entries and gives those that are repeats."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> list[np.ndarray]:
        out = []
        batch = batch[np.lexsort((batch["at"], batch["nth"], batch["doc"], batch["print"]))]
        later = np.zeros(len(batch), bool)
        later[1:] = batch["print"][1:] == batch["print"][:-1]
        out.append(batch[later])
        batch = batch[~later]
        for level in self.levels:
            if not len(batch) or not len(level):
                continue
            where = np.minimum(np.searchsorted(level["print"], batch["print"]), len(level) - 1)
            same = level["print"][where] == batch["print"]
            if not same.any():
                continue
            mine, held = batch[same], level[where[same]]
            before = (mine["nth"] < held["nth"]) | ((mine["nth"] == held["nth"]) & (mine["at"] < held["at"]))
            older = (mine["doc"] < held["doc"]) | ((mine["doc"] == held["doc"]) & before)
            out.append(np.where(older, held, mine))
            level[where[same][older]] = mine[older]
            batch = batch[~same]
        if len(batch):
            self.levels.append(batch.copy())
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            two = np.concatenate((self.levels.pop(), self.levels.pop()))
            self.levels.append(two[np.argsort(two["print"], kind="stable")])
        return [x for x in out if len(x)]

    def rest(self) -> Iterator[np.ndarray]:
        yield from self.levels


def _rows(x: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.ascontiguousarray(x[c])) for c in ("anchor", "context", "doc", "nth", "at", "n")]
    return pa.RecordBatch.from_arrays(cols, names=["anchor", "context", "doc_id", "nth", "at", "n"])


def _spans(found: list[np.ndarray], length: int) -> pa.RecordBatch | None:
    """Byte spans of repeated runs as rows without an anchor; neighbours of one document are joined."""
    if not found:
        return None
    x = np.concatenate([f[["doc", "nth", "at", "n"]] for f in found])
    x = x[np.lexsort((x["at"], x["nth"], x["doc"]))]
    begin, end = x["at"], x["at"] + x["n"] - 1 + length
    # ends of runs of one document ascend with their starts but for the last bytes, so joining neighbours is enough
    new = np.ones(len(x), bool)
    new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["nth"][1:] != x["nth"][:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, first)
    none = pa.nulls(len(first), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(np.ascontiguousarray(x["doc"][first])), pa.array(np.ascontiguousarray(x["nth"][first])), pa.array(np.ascontiguousarray(begin[first])), pa.array(stop - begin[first])], names=["anchor", "context", "doc_id", "nth", "at", "n"])


def _scan(make, length: int):
    """mapInArrow over texts: make(batch) gives entries; repeats in the task come out as spans, the rest as entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixLevels()
        with np.errstate(over="ignore"):
            for batch in batches:
                spans = _spans(family.add(make(batch)), length)
                if spans is not None:
                    yield spans
            for level in family.rest():
                order = np.lexsort((level["at"], level["nth"], level["doc"]))  # entries of a document side by side take less of the shuffle
                for at in range(0, len(level), 1 << 17):
                    yield _rows(level[order[at : at + (1 << 17)]])

    return run


def _meet(length: int):
    """mapInArrow over entries sorted by anchor, context and place: repeats as spans, and runs whose anchor has several contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last anchor's first entry, its last context, and whether the entry has gone out
        for batch in batches:
            known = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield batch.filter(pa.array(known))
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            x = np.empty(batch.num_rows, ENTRY)
            for c, column in zip(("anchor", "context", "doc", "nth", "at", "n"), batch.columns, strict=True):
                x[c] = column.to_numpy(zero_copy_only=False)
            same_anchor, same = np.zeros(len(x), bool), np.zeros(len(x), bool)
            same_anchor[1:] = x["anchor"][1:] == x["anchor"][:-1]
            same[1:] = same_anchor[1:] & (x["context"][1:] == x["context"][:-1])
            if held is not None:
                same_anchor[0] = x["anchor"][0] == held[0]["anchor"]
                same[0] = same_anchor[0] and x["context"][0] == held[1]
            repeats = x[same]
            if len(repeats):
                yield _spans([repeats], length)
            last_context = x["context"][-1]
            firsts, with_before = x[~same], same_anchor[~same]
            if len(firsts):
                shared = with_before.copy()
                shared[:-1] |= with_before[1:]
                if with_before[0] and held is not None and not held[2]:
                    yield _rows(held[0].reshape(1))
                begins = np.flatnonzero(~with_before)
                tail = len(firsts) - 1
                if len(begins) and begins[-1] == tail:  # its anchor may go on in the next batch
                    held = [firsts[tail].copy(), last_context, False]
                    shared[tail] = False
                elif len(begins):
                    held = [firsts[begins[-1]].copy(), last_context, True]
                else:
                    held = [held[0], last_context, True]
                if shared.any():
                    yield _rows(firsts[shared])
            elif held is not None:
                held[1] = last_context

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", nth: str | None = None) -> DataFrame:
    """(doc_id, nth, at, n): byte spans to remove; spans of a document may overlap. `nth` names a column that tells rows with one key apart."""
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(nth) if nth else F.lit(0).cast("long")).alias("nth"))

    def from_texts(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = column_bytes(batch.column(1))
        return entries(data, offsets, np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min)), np.asarray(batch.column(2)), length)

    def from_edges(batch: pa.RecordBatch) -> np.ndarray:
        """Each window of the given runs as an entry of its own."""
        data, offsets = column_bytes(batch.column(2))
        nth = np.asarray(batch.column(1))
        ids = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min))
        runs = batch.column(3)
        flat, at = runs.flatten(), np.asarray(runs.offsets) - runs.offsets[0].as_py()
        begin, n, anchor = (np.asarray(flat.field(i)) for i in range(3))
        row = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.lexsort((begin, row))
        begin, n, anchor, row = begin[order], n[order], anchor[order], row[order]
        start = np.repeat(offsets[row] + begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        anchor, row = np.repeat(anchor, n), np.repeat(row, n)
        hashes = np.empty(len(start), np.uint64)
        for p in range(0, len(data), CHUNK):
            a, b = np.searchsorted(start, [p, p + CHUNK])
            if b > a:
                prints = Prints(data[p : p + CHUNK + length])
                hashes[a:b] = prints.of(start[a:b] - p, start[a:b] - p + length)
        out = np.empty(len(start), ENTRY)
        out["anchor"], out["context"] = hashes.view(np.int64), anchor
        out["print"] = mix(hashes ^ (anchor.view(np.uint64) << np.uint64(1)))
        out["doc"], out["nth"], out["at"], out["n"] = ids[row], nth[row], start - offsets[row], 1
        return out

    def over_all(found: DataFrame) -> DataFrame:
        dealt = found.repartition(F.coalesce("anchor", F.xxhash64("doc_id", "nth", "at")))
        return dealt.sortWithinPartitions("anchor", "context", "doc_id", "nth", "at").mapInArrow(frugal(_meet(length)), FOUND)

    first = store.materialize(over_all(docs.mapInArrow(frugal(_scan(from_texts, length)), FOUND)), "runs")
    store.release(spark)
    edges = first.where("anchor is not null").groupBy("doc_id", "nth").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("runs"))
    # null ids have been given the least long above
    texts = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    second = over_all(texts.join(edges, ["doc_id", "nth"]).mapInArrow(frugal(_scan(from_edges, length)), FOUND))
    second = store.materialize(second.where("anchor is null").select("doc_id", "nth", "at", "n"), "windows")
    store.release(spark)
    return first.where("anchor is null").select("doc_id", "nth", "at", "n").unionByName(second)


CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def cut_documents(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes; without those of characters cut in two, if asked) under names with a prefix of their own, `r_` if no column has it."""
    names, p = docs.columns, store.fresh(docs.columns, "r_")
    own = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    docs = store.numbered(docs, own, f"{p}nth")
    spans = repeated_spans(docs, length, key, text, f"{p}nth").groupBy("doc_id", "nth").agg(F.collect_list(F.struct("at", "n")).alias(f"{p}spans"))
    spans = spans.withColumnsRenamed({"doc_id": f"{p}id", "nth": f"{p}nth"})
    joined = docs.withColumn(f"{p}id", own).join(spans, [f"{p}id", f"{p}nth"], "left").select(*names, f"{p}spans")
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            sizes, removed, runs, kept = [], [], [], []
            for value, own in zip(batch.column(place).cast(pa.large_binary()).to_pylist(), spans, strict=True):
                raw, parts, at, gone, n = value or b"", [], 0, 0, 0
                end = -1
                for begin, size in sorted((x["at"], x["n"]) for x in own or ()):
                    if begin > end:  # a new maximal run
                        parts.append(raw[at:begin])
                        n += 1
                        end = begin
                    gone += max(0, begin + size - max(end, begin))
                    end = at = max(end, begin + size)
                parts.append(raw[at:])
                sizes.append(len(raw))
                removed.append(gone)
                runs.append(n)
                if whole_characters and len(parts) > 1:  # each part is of valid text, so only its edges can be broken
                    parts = [x.decode("utf-8", "ignore").encode() for x in parts]
                kept.append(b"".join(parts))
            found = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(list(batch.columns[: len(names)]) + found, names=[*names, *[p + x.split(" ")[0] for x in CUT.split(", ")]])

    schema = StructType([docs.schema[x] for x in names])  # add() changes its own object
    for field in CUT.split(", "):
        schema = schema.add(p + field.split(" ")[0], field.split(" ")[1])
    return joined.mapInArrow(frugal(run), schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    cut = cut_documents(docs.select("doc_id", "text"), length)
    return cut.select("doc_id", *[F.col(f"r_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.sha2("r_kept", 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """docs without their repeats; bytes of a character cut in two go too. n_chars, where there is one, is counted anew."""
    p = store.fresh(docs.columns, "r_")
    cut = cut_documents(docs, length, text=text, whole_characters=True)
    out = cut.withColumn(text, F.when(F.col(f"{p}n_removed") > 0, F.col(f"{p}kept").cast("string")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{p}n_removed") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
