"""Best-fit packing with swap-based local search, over counts of lengths.

Pieces of one length are interchangeable, so packing is decided on the histogram of lengths
(at most `capacity` numbers, whatever the input): best-fit decreasing gives classes of equal
bins, and local search moves and swaps pieces between underfull classes - one piece for
nothing, one for one, one for two - whenever the sum of squared fills grows, until bins empty. It ends when
the bound on bins (all lengths over the capacity) is met or no exchange is left. Where many short
texts fill every gap, best fit is at the bound already; where lengths are alike, the search
empties bins (20,000 lengths of 500 to 1,100 for 2,048: 8,471 bins, then 8,232; the bound is 7,841).
Each piece then finds its bin from its length and its rank among pieces of that length. The
plan sent to the tasks has one entry for each slot of each class; classes are bounded by the
capacity, not by the data.

Defined cases: null text is empty and still has its end id. Only documents longer than the
capacity are cut, into full pieces behind a first one that may be shorter. Repeated rows are
packed one by one. A null doc_id stays null. Extra columns are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import store
from keyloom.llm.tokens import lent, resolve

Pattern = tuple[int, ...]


def best_fit(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing on counts: pattern of lengths (descending) -> number of bins."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, bins]
    rooms: list[int] = []
    done: Counter[Pattern] = Counter()

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not room:
            done[pattern] += n
            return
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append([pattern, n])

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = capacity // length
                if left >= per:
                    put(capacity - per * length, (length,) * per, left // per)
                if left % per:
                    put(capacity - left % per * length, (length,) * (left % per), 1)
                break
            room = rooms[i]
            pattern, n = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(i)
            take = min(n, left)
            if n > take:
                put(room, pattern, n - take)
            put(room - length, (*pattern, length), take)
            left -= take
    for room in rooms:
        for pattern, n in open_bins[room]:
            done[pattern] += n
    return done


class _Under:
    """The classes of underfull bins, and every offer that one of them can make as a host: what it gives back for a piece."""

    def __init__(self, bins: dict[Pattern, int], capacity: int) -> None:
        self.capacity = capacity
        self.place: dict[Pattern, int] = {}
        self.patterns: list[Pattern] = []
        self.count = np.zeros(0, np.int64)
        self.fill = np.zeros(0, np.int64)
        self.stuck = np.zeros(0, bool)
        self.host = self.back = np.zeros(0, np.int64)
        self.given: list[Pattern] = []
        self._late: list[tuple[int, int, Pattern]] = []
        for pattern, n in bins.items():
            self.add(pattern, n)

    def add(self, pattern: Pattern, n: int) -> None:
        i = self.place.get(pattern)
        if i is None:
            i = self.place[pattern] = len(self.patterns)
            self.patterns.append(pattern)
            if i >= len(self.count):
                grow = max(64, i)
                self.count, self.fill, self.stuck = (np.concatenate((x, np.zeros(grow, x.dtype))) for x in (self.count, self.fill, self.stuck))
            self.fill[i] = sum(pattern)
            kinds = sorted(set(pattern))
            twice = {y for y, c in Counter(pattern).items() if c > 1}
            given = [(), *((y,) for y in kinds), *((y, z) for k, y in enumerate(kinds) for z in kinds[k:] if y != z or y in twice)]
            self._late += [(i, sum(back), back) for back in given if sum(back) < self.capacity]
        self.count[i] += n
        self.stuck[i] = False

    def offers(self) -> None:
        if self._late:
            self.host = np.concatenate((self.host, [x[0] for x in self._late]))
            self.back = np.concatenate((self.back, [x[1] for x in self._late]))
            self.given += [x[2] for x in self._late]
            self._late = []
        alive = self.count[self.host] > 0
        if len(alive) > 4096 and alive.mean() < 0.5:  # forget the classes that are gone
            kept = {p: int(self.count[i]) for p, i in self.place.items() if self.count[i]}
            stuck = {p for p, i in self.place.items() if self.stuck[i]}
            self.__init__(kept, self.capacity)
            for p in stuck & set(kept):
                self.stuck[self.place[p]] = True
            self.offers()

    def exchange(self, donor: int) -> tuple[int, Pattern, Pattern] | None:
        """Host, and the patterns of donor and host after the exchange that fills a host most; the sum of squares must grow."""
        best, fill = None, 0
        before = self.fill[self.host]
        usable = (self.count[self.host] > (self.host == donor)) & (before < self.capacity)
        for x in sorted(set(self.patterns[donor]), reverse=True):
            gain = x - self.back
            after = before + gain
            # squares grow by 2 * gain * (host + gain - donor)
            after = np.where(usable & (gain > 0) & (after <= self.capacity) & (after > self.fill[donor]), after, 0)
            k = int(after.argmax()) if len(after) else 0
            if len(after) and after[k] > fill:
                fill, best = int(after[k]), (int(self.host[k]), x, self.given[k])
        if best is None:
            return None
        host, x, back = best
        mine, other = list(self.patterns[donor]), list(self.patterns[host])
        mine.remove(x)
        for y in back:
            other.remove(y)
        return host, tuple(sorted([*mine, *back], reverse=True)), tuple(sorted([*other, x], reverse=True))


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Exchange pieces between underfull bins, all bins of a class at once, until the bound on bins is met or no exchange is left.

    The least filled class gives first. Every exchange makes the sum of squared fills grow, so the search ends."""
    bins = +bins
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    under = _Under({p: n for p, n in bins.items() if sum(p) < capacity}, capacity)
    full = Counter({p: n for p, n in bins.items() if sum(p) == capacity})
    total, changed = sum(bins.values()), False
    while total > least:
        under.offers()
        able = np.flatnonzero((under.count > 0) & ~under.stuck)
        if not len(able):
            if not changed:
                break
            under.stuck[:], changed = False, False  # hosts have changed since some donors were given up
            continue
        donor = int(able[under.fill[able].argmin()])
        found = under.exchange(donor)
        if found is None:
            under.stuck[donor] = True
            continue
        changed = True
        host, *after = found
        n = int(under.count[donor]) // 2 if host == donor else int(min(under.count[donor], under.count[host]))
        under.count[donor] -= n
        under.count[host] -= n
        for pattern in after:
            if not pattern:
                total -= n
            elif sum(pattern) == capacity:
                full[pattern] += n
            else:
                under.add(pattern, n)
    return full + Counter({p: int(under.count[i]) for p, i in under.place.items() if under.count[i]})


def slots(bins: Counter[Pattern]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks: which sequences (one for each rank) and where in them."""
    used: Counter[int] = Counter()
    rows, base = [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        at = 0
        for length in pattern:
            rows.append((length, used[length], base, at))
            used[length] += n
            at += length
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank among those of its length in its task."""
    model = resolve(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        with lent(model) as known:
            for batch in batches:
                rows: list[list] = [[] for _ in range(7)]
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = known.encode(x or "") + end
                    n = len(ids) // 4
                    at, i = 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        for col, v in zip(rows, (k, i, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), task, seen[size]), strict=True):
                            col.append(v)
                        seen[size] += 1
                        at, i = at + size, i + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, task long, nth long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = store.materialize(pieces(docs, capacity, tokenizer, end_id), "pieces")
    counts = store.materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # one window row for each length and task, never for each piece
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = slots(local_search(best_fit(histogram, capacity), capacity))
    order = plan["length"] * (1 << 44) + plan["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(3))
            rank = np.asarray(batch.column(5))
            where = np.searchsorted(order, length * (1 << 44) + rank, "right") - 1
            sequence = plan["sequence"][where] + rank - plan["rank"][where]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *batch.columns[2:5], pa.array(sequence), pa.array(plan["offset"][where])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
