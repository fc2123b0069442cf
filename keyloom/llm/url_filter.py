"""URL filter: longest-match rules, and a character language-model ratio for what no rule fits.

Two variable-order Markov models over the bytes of the UTF-8 text (a character of almost every URL is one
byte), one of accepted and one of rejected URLs,
learn from every URL that a rule decides. Orders 0 to 4 are interpolated by Witten and Bell's smoothing: a
context that was seen n times with k kinds of next byte gives the next shorter one the weight k / (n + k). The
first bytes of a text have its start in their contexts. The counts are exact: a table with a row for
every 5-byte gram learnt, which grows with the corpus; shorter grams and contexts are its sums. The
distinct grams of the URLs are joined to it order by order, and URLs meet their grams in chunks, so
that a gram of all URLs is one row a chunk.
A URL's score is the difference of the two log-likelihoods by character; the
threshold is the `quantile` of held-out accepted URLs' scores (one in ten by hash), so that
about that share of good URLs would be lost.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and has
score 0. Without accepted or without rejected URLs to learn from every score is 0. Scores from
the threshold up are allowed, and 0 always when nothing was learnt. Repeated rows are judged one by
one. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import store
from keyloom.llm.bytetext import column_bytes

ORDERS = 5
BITS = 9  # of a symbol: a byte, or 256 before the start
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3, F.char_length(text))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (struct of name and allow), or null. Ties: the smaller name."""
    out = F.lit(None).cast("struct<name:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte the gram of ORDERS symbols that ends there, oldest first, as one number."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(data), np.int64)
    for back in reversed(range(ORDERS)):
        symbol = np.full(len(data), 256, np.int64)
        symbol[back:] = data[: len(data) - back]
        symbol[place < back] = 256
        out = (out << BITS) | symbol
    return out


def learn(urls: DataFrame) -> DataFrame:
    """gram, good, bad: how often accepted and rejected ones of (url, allow) rows hold each longest gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            kind = np.repeat(np.asarray(batch.column(1).cast(pa.int8())), np.diff(offsets)).astype(np.int64)
            keys, n = np.unique(_grams(data, offsets) * 2 + kind, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1) * n, pa.int64()), pa.array((1 - (keys & 1)) * n, pa.int64())], names=["gram", "good", "bad"])

    return urls.select("url", "allow").mapInArrow(run, "gram long, good long, bad long").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def ratios(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, ratio: log-likelihood of the last byte when accepted less that when rejected, for distinct longest grams."""
    suffix = lambda order: F.col("gram").bitwiseAND(F.lit((1 << BITS * (order + 1)) - 1))
    likely = None
    for order in range(ORDERS):
        # a shorter gram ends at most 257 grams that are one longer, so no key is much more frequent than others
        frame = asked.select(suffix(order).alias("gram")).distinct()
        seen = counts.groupBy(suffix(order).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = F.shiftright("gram", BITS).alias("context")
        kinds = [F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for x in ("good", "bad")]
        whole = seen.groupBy(context).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), *kinds)
        frame = frame.join(seen, "gram", "left").select("*", context).join(whole, "context", "left").na.fill(0)
        if order:
            frame = frame.withColumn("shorter", suffix(order - 1)).join(likely.withColumnRenamed("gram", "shorter"), "shorter")
        else:
            frame = frame.withColumns({"p_good": F.lit(1.0 / 256), "p_bad": F.lit(1.0 / 256)})
        mixed = lambda x: (F.col(x) + F.col(f"kinds_{x}") * F.col(f"p_{x}")) / (F.col(f"all_{x}") + F.col(f"kinds_{x}"))
        p = lambda x: F.when(F.col(f"all_{x}") > 0, mixed(x)).otherwise(F.col(f"p_{x}")).alias(f"p_{x}")  # noqa: B023, E731
        likely = store.materialize(frame.select("gram", p("good"), p("bad")), "likely")
    return likely.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """urls (with url) and their score: the mean ratio of their bytes, 0 without any."""
    own = urls.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, offsets = column_bytes(batch.column(own.index("url")))
            chunk = number + np.arange(batch.num_rows) // CHUNK_ROWS + offsets[1:] // CHUNK_BYTES
            number = int(chunk[-1]) + 1 if len(chunk) else number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64())], names=[*own, "chunk"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            grams, chunk = _grams(data, offsets), np.repeat(np.asarray(batch.column(0)), np.diff(offsets))
            for c in np.unique(chunk):
                found = np.unique(grams[chunk == c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c), pa.int64()), pa.array(found)], names=["chunk", "gram"])

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        data, offsets = column_bytes(rows.column("url").combine_chunks())
        gram, ratio = np.asarray(known.column("gram").combine_chunks()), np.asarray(known.column("ratio").combine_chunks())
        order = np.argsort(gram)
        total = ratio[order][np.searchsorted(gram[order], _grams(data, offsets))] if len(data) else np.zeros(0)
        edge = np.concatenate(([0.0], np.cumsum(total)))
        found = (edge[offsets[1:]] - edge[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
        return rows.drop_columns(["chunk"]).append_column("score", pa.array(found, pa.float64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema.fields)
    dealt = store.materialize(urls.mapInArrow(deal, f"{fields}, chunk long"), "urls")
    met = store.materialize(dealt.select("chunk", "url").mapInArrow(ask, "chunk long, gram long"), "grams")
    known = met.join(ratios(store.materialize(met.select("gram").distinct(), "asked"), counts), "gram")
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, f"{fields}, score double")


def judge(pages: DataFrame, rules: list[Rule], quantile: float = 0.005, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    host, path = host_and_path(F.col("url"))
    plain = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    ruled = plain.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    held = F.pmod(F.xxhash64("url"), F.lit(10)) == 0
    known = ruled.where("fit is not null").where(~held)
    counts = store.materialize(learn(known.select("url", F.col("fit.allow").alias("allow"))), "counts")
    sides = counts.agg(F.max("good").alias("good"), F.max("bad").alias("bad")).first()
    learnt = bool(sides["good"] and sides["bad"])
    found = store.materialize(scored(ruled, counts), "scored") if learnt else ruled.withColumn("score", F.lit(0.0))
    limit = found.where(held & F.col("fit.allow")).agg(F.percentile_approx("score", quantile, 100_000).alias("t")).first()["t"] if learnt else None
    threshold = 0.0 if limit is None else min(0.0, limit)
    allow = F.coalesce(F.col("fit.allow"), F.col("score") >= threshold)
    return found.select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), "score")
