"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers, floor(scale * x). In a block of vectors the postings of every
dimension (row and component, for components other than 0) are put into segments by quantised impact: the bit length
of the component's magnitude. Segments are processed from the highest impact down, posting list by posting list, for
the queries of a block that aren't settled yet, adding exact partial products. What a vector has left is bounded by the norms of the
unprocessed rests of query and vector, known from the index (Cauchy-Schwarz). When at most
`few` vectors can still reach a query's k-th best lower bound, the others are proven out: the
query is settled and its possible members are rescored exactly; without such proof every segment is processed,
which is exact as well.

Query blocks meet vector blocks in cells of bounded size; each cell gives its k best and a
window takes the best of those. No row is left out and no cell grows with the data.

Every vector meets every block of queries, as exact answers need it to.

Defined cases: vectors that are null or hold a null or non-finite component take no part.
Shorter vectors, empty ones too, count as followed by zeros. Rows with one id count as one vector, the
smallest array. Ties go to the smaller id. Scores must fit 64 bits. An empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = float(1 << 53)


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1]


class ImpactIndex:
    """A block of integer vectors: posting lists in segments by bit length, highest first, and the norms of what is left after each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        bits = _bits(self.vectors)
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.left: list[np.ndarray] = []
        levels = sorted(set(np.unique(bits).tolist()) - {0}, reverse=True)
        for high, *low in (levels[i : i + 2] for i in range(0, len(levels), 2)):  # two bit lengths make one quantised impact
            least = low[0] if low else high
            dims, rows = np.nonzero(((bits <= high) & (bits >= least)).T)
            cut = np.flatnonzero(np.diff(dims, prepend=-1))
            lists = zip(dims[cut].tolist(), np.split(rows, cut[1:]), strict=True) if len(dims) else ()
            self.segments.append([(d, r, self.vectors[r, d]) for d, r in lists])
            rest = np.where(bits < least, self.vectors, 0.0)
            self.left.append(np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9))
        self.largest = np.abs(self.vectors).max(initial=0.0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, few: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of each query's k best among this block, itself excepted."""
        n = len(self.ids)
        q = queries.astype(np.float64)
        if not n or not len(q):
            return tuple(np.empty(0, np.int64) for _ in range(3))
        if np.abs(q).max(initial=0) * self.largest * max(1, q.shape[1]) >= EXACT:
            return self._wide(query_ids, queries, k)
        own = np.searchsorted(self.ids, query_ids)
        own = np.where(self.ids[np.minimum(own, n - 1)] == query_ids, np.minimum(own, n - 1), -1)
        norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
        members: list[tuple[np.ndarray, np.ndarray]] = []  # places of queries and of their possible members
        asked = np.arange(len(q))
        scores = np.zeros((n, len(q)))
        last = len(self.segments) - 1
        if n <= k or last < 0:
            members.append((np.repeat(asked, n), np.tile(np.arange(n), len(q))))
            asked = asked[:0]
        for at, (segment, left) in enumerate(zip(self.segments, self.left, strict=True)):
            if not len(asked):
                break
            for d, rows, values in segment:
                scores[rows] += values[:, None] * q[asked, d]
            spread = left[:, None] * norm[asked]
            low = (scores - spread).T
            mine = np.flatnonzero(own[asked] >= 0)
            low[mine, own[asked[mine]]] = -np.inf
            floor = np.partition(low, n - k, axis=1)[:, n - k]
            possible = scores + spread >= floor
            settled = (possible.sum(axis=0) <= few) | (at == last)  # proven: nothing else can be among the k best
            row, col = np.nonzero(possible[:, settled])
            members.append((asked[settled][col], row))
            asked, scores = asked[~settled], scores[:, ~settled]
        row, col = (np.concatenate(x) for x in zip(*members, strict=True))
        other = own[row] != col
        row, col = row[other], col[other]
        exact = np.einsum("ij,ij->i", q[row], self.vectors[col]).astype(np.int64)
        order = np.lexsort((self.ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = nth < k
        return query_ids[row[best]], self.ids[col[best]], exact[best]

    def _wide(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integers too large for exact doubles: every product in Python's integers."""
        out: list[tuple[int, int, int]] = []
        vectors = self.vectors.astype(np.int64).astype(object)
        for i, x in zip(query_ids, queries.astype(np.int64).astype(object), strict=True):
            found = sorted((-int(s), int(j)) for s, j in zip(vectors @ x, self.ids, strict=True) if j != i)[:k]
            out += [(int(i), j, -s) for s, j in found]
        a = np.array(out, np.int64).reshape(-1, 3)
        return a[:, 0], a[:, 1], a[:, 2]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, vector_block: int = 16384, query_block: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all vectors for each query."""

    def prepared(df: DataFrame) -> DataFrame:
        usable_rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null").where(usable(F.col("v")))
        return usable_rows.groupBy("id").agg(F.min("v").alias("v")).select("id", integers(F.col("v"), scale).alias("v"))

    n, m = vectors.count(), queries.count()
    vector_blocks, query_blocks = max(1, -(-n // vector_block)), max(1, -(-m // query_block))
    spread = lambda df, own, other, own_blocks: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_blocks))).withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other[1] - 1).cast("long"))))
    left = spread(prepared(vectors), "vb", ("qb", query_blocks), vector_blocks)
    right = spread(prepared(queries), "qb", ("vb", vector_blocks), query_blocks)

    def cell(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(max(map(len, mine["v"])), max(map(len, asked["v"])))

        def matrix(column: pd.Series) -> np.ndarray:
            out = np.zeros((len(column), width), np.int64)
            for i, x in enumerate(column):
                out[i, : len(x)] = x
            return out

        index = ImpactIndex(mine["id"].to_numpy(), matrix(mine["v"]))
        ids, asked_for = asked["id"].to_numpy(), matrix(asked["v"])
        parts = [index.search(ids[a : a + 128], asked_for[a : a + 128], k) for a in range(0, len(ids), 128)]
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    cells = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
