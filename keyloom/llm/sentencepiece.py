"""SentencePiece encoding and decoding over a relational lattice.

A text becomes `▁` + text with spaces as `▁`, cut into words where no piece of more than one character can cross:
before a run of `▁`, around line breaks, and between a run of letters and a run of other characters (a character that
some piece joins to a letter counts as a letter; the model's pieces decide). Each distinct word is encoded once: its
substrings of bounded length are exploded and equi-joined to the piece table (its size is the model's, not the
data's), edges are grouped by word, each as one number, and Viterbi folds them from left to right, a batch of words
at a time. The result is the segmentation of the largest summed score; ties go to the longer last piece, then
the smaller id. A character without a piece falls back to its UTF-8 bytes at the model's unknown
penalty. A BPE model holds merge ranks in place of
log-probabilities; pieces then score -log(id + 2), as Zipf's law has it, and the optimum can differ from
the library's greedy merges; it always decodes to the same text.

Words meet their ids by a broadcast of the most frequent ones (at most `dictionary` words of at most `dictionary_bytes`
bytes together, so hot words of any length are among them) and, for the others, by a shuffle join. The words of a
text are put together where the whole text was dealt to, a block of BLOCK_WORDS at a time, so no batch for Python
holds more of a long text.

Defined cases: null and empty texts have no words and no ids. Every row is encoded by itself, also rows that share a
doc_id or have none; `encode` and `digest` give one row for each. Extra columns are ignored. A text of any length is
taken whole. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from keyloom.llm import store
from keyloom.llm.tokens import resolve
from keyloom.llm.workers import Run, frugal, give_back

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
TASK_WORDS = 20_000  # distinct words whose lattices one task folds, about
PARTS = 2  # of the texts, dealt one after the other
TASK_BYTES = 6 << 20  # of texts whose words one task puts together, about
BLOCK = 64  # characters of a word that are cut out at once
HEAD = 3  # characters by which longer pieces are looked for
BLOCK_WORDS = 2048  # words of a text that are put together at once
BATCH_BLOCKS = 2000  # blocks that Python gets at once
BATCH_EDGES = 1 << 18  # of words folded at once, unless one word has more
ID_BITS, SIZE_BITS = 24, 8  # of an edge: end, 255 - characters, id
NO_PIECE = (1 << ID_BITS) - 1


class Pieces:
    """The piece table of a model file."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=resolve(model))
        self.rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if all(s == int(s) for _, _, s in self.rows):  # merge ranks, not log-probabilities
            self.rows = [(p, i, -math.log(i + 2.0)) for p, i, _ in self.rows]
        self.longest = max((len(p) for p, _, _ in self.rows), default=1)
        self.least = min((s for _, _, s in self.rows), default=0.0)
        if any("\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE) for p, _, _ in self.rows):
            raise ValueError("a piece crosses a word's edge")
        if self.longest >= 1 << SIZE_BITS or max((i for _, i, _ in self.rows), default=0) >= NO_PIECE:
            raise ValueError("a piece is too long or has too large an id")
        self.letters = joined_to_letters([p.lstrip(SPACE) for p, _, _ in self.rows])
        letter, other = f"[\\p{{L}}\\p{{M}}{self._class()}]", f"[^\\p{{L}}\\p{{M}}{self._class()}{SPACE}\\n]"
        self.word = f"{SPACE}+(?:{letter}+|{other}+)?|{letter}+|{other}+|\\n"

    def _class(self) -> str:
        return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(self.letters))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i) for p, i, _ in self.rows], "piece string, id int").coalesce(1)

    def sizes(self, spark: SparkSession) -> DataFrame:
        """The sizes of the pieces of HEAD characters or more that begin with a head."""
        of: dict[str, set[int]] = {}
        for p, _, _ in self.rows:
            if len(p) >= HEAD:
                of.setdefault(p[:HEAD], set()).add(len(p))
        return spark.createDataFrame([(h, sorted(n)) for h, n in of.items()], "head string, sizes array<int>").coalesce(1)

    def raw(self) -> pa.Array:
        """The bytes by id, none for ids that are no piece and for the last."""
        by_id = {i: p.encode() for p, i, _ in self.rows} | {i: bytes([b]) for b, i in self.bytes.items()}
        return pa.array([by_id.get(i, b"") for i in range(max(by_id, default=0) + 2)], pa.binary())


def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


def joined_to_letters(pieces: list[str]) -> set[str]:
    """Characters that are no letters but that some piece joins to one, or to another such character."""
    found: set[str] = set()
    mixed = [set(p) for p in pieces if len(p) > 1]
    while True:
        more = {c for p in mixed if any(is_letter(c) or c in found for c in p) for c in p if not is_letter(c)} - found
        if not more:
            return found
        found |= more


def words(text: Column, pieces: Pieces) -> Column:
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.char_length(text) > 0, F.regexp_extract_all(marked, F.lit(pieces.word), F.lit(0))).otherwise(F.array().cast("array<string>"))


def edges(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """wid, edge: every piece that lies in a word, and the fallback of characters without one.

    An edge is one number, so that edges sort by their end, then from long to short, then by id."""
    spark = distinct.sparkSession
    size, at = F.char_length("word"), F.col("b") * BLOCK
    # a word is cut by blocks first: finding a character in a string takes time in proportion to its place
    blocks = distinct.select("wid", "word", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))).alias("b"))
    blocks = blocks.select("wid", at.alias("before"), F.substr("word", at + 1, F.lit(BLOCK + pieces.longest - 1)).alias("part"))
    size = F.char_length("part")
    begun = blocks.select("wid", "before", "part", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(BLOCK)) - 1)).alias("start"))
    # of the long substrings only those of a size that some piece with their head has
    headed = begun.withColumn("head", F.substr("part", F.col("start") + 1, F.lit(HEAD))).join(F.broadcast(pieces.sizes(spark)), "head", "left")
    sizes = F.concat(F.lit(list(range(1, HEAD))), F.coalesce("sizes", F.array().cast("array<int>")))
    cut = headed.select("wid", "before", "part", "start", F.explode(sizes).alias("n")).where(F.col("n") <= size - F.col("start"))
    cut = cut.select("wid", (F.col("before") + F.col("start") + F.col("n")).alias("end"), "n", F.substr("part", F.col("start") + 1, F.col("n")).alias("sub"))
    met = cut.join(F.broadcast(pieces.table(spark).withColumnRenamed("piece", "sub")), "sub", "left").where("id is not null or n = 1")
    short_last = F.shiftleft((F.lit((1 << SIZE_BITS) - 1) - F.col("n")).cast("long"), ID_BITS)
    return met.select("wid", F.shiftleft(F.col("end").cast("long"), ID_BITS + SIZE_BITS).bitwiseOR(short_last).bitwiseOR(F.coalesce("id", F.lit(NO_PIECE)).cast("long")).alias("edge"))


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(sizes)])


def fold(words: pa.Array, edges: pa.Array, scores: np.ndarray, by_byte: list[int] | None, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the best path through each word, one word after the other, and how many each has.

    edges are each word's, sorted. scores are by id; the last is that of a character without a piece."""
    per_word, edge = lengths(edges), edges.flatten().to_numpy()
    first = starts(per_word)
    end, size, piece = edge >> (ID_BITS + SIZE_BITS), (1 << SIZE_BITS) - 1 - ((edge >> ID_BITS) & ((1 << SIZE_BITS) - 1)), edge & NO_PIECE
    long = end[first[1:] - 1]  # every end has an edge, so the last edge ends the word
    base = starts(long + 1)[:-1]
    to = np.repeat(base, per_word) + end
    origin = to - size
    total, chosen = np.full(int(np.sum(long + 1)), -np.inf), np.zeros(int(np.sum(long + 1)), np.int64)
    total[base] = 0.0
    total, chosen = total.tolist(), chosen.tolist()
    # edges sort by their end, so what an edge begins at is done; the first of equal totals stays
    for k, (a, b, score) in enumerate(zip(origin.tolist(), to.tolist(), scores[np.minimum(piece, len(scores) - 1)].tolist())):
        sum_here = total[a] + score
        if sum_here > total[b]:
            total[b], chosen[b] = sum_here, k
    chosen, on = np.array(chosen, np.int64), np.zeros(len(edge), np.int64)
    at, start = base + long, base
    while len(at):  # back from the ends, all words at once
        k = chosen[at]
        on[k] = 1
        at = origin[k]
        at, start = at[at > start], start[at > start]
    path = np.flatnonzero(on)
    bare = path[piece[path] == NO_PIECE]
    bytes_of = [[unknown]] * len(bare)
    if by_byte is not None:
        of = np.searchsorted(first, bare, side="right") - 1
        text = dict(zip(of.tolist(), words.take(pa.array(of)).to_pylist()))
        bytes_of = [[by_byte[b] for b in text[w][e - 1].encode()] for w, e in zip(of.tolist(), end[bare].tolist())]
    on[bare] = [len(x) for x in bytes_of]
    ids, place = np.repeat(piece[path], on[path]), starts(on)
    for k, x in zip(bare.tolist(), bytes_of):
        ids[place[k] : place[k] + len(x)] = x
    return ids, np.add.reduceat(on, first[:-1])


def best_ids(pieces: Pieces) -> Callable[[str, str], Column]:
    """The ids of a word from it and its sorted edges: its pieces', and those of the bytes of characters without one."""
    by_id, unknown = {i: s for _, i, s in pieces.rows}, pieces.unknown
    scores = np.array([by_id.get(i, pieces.least) for i in range(max(by_id, default=0) + 1)] + [pieces.least - UNKNOWN_PENALTY])
    by_byte = [pieces.bytes.get(b, unknown) for b in range(256)] if pieces.bytes else None

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for words, edges in batches:
                ids, sizes, at, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, np.cumsum(lengths(edges))
                while at < len(words):
                    n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_EDGES, side="right")) - at)
                    found = fold(words.slice(at, n), edges.slice(at, n), scores, by_byte, unknown)
                    ids.append(found[0])
                    sizes.append(found[1])
                    at += n
                yield pa.ListArray.from_arrays(pa.array(starts(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        finally:
            give_back()

    return arrow_udf(run, "array<int>", ArrowUDFType.SCALAR_ITER)


def put_together(frequent: pa.Table, keys: list[str]) -> Run:
    """keys, n_words, ids of every text, from keys and b, words, rare of its blocks: their numbers, their words and the places in the text and ids of the rare ones among these. A text's blocks follow one another."""
    known, known_ids = (frequent.column(c).combine_chunks() for c in ("word", "ids"))

    def texts(of: pa.RecordBatch, sizes: list | np.ndarray, first: list | np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([*(of.column(k) for k in keys), pa.array(sizes, pa.int64()), lists], names=[*keys, "n_words", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text, n_words, parts = None, 0, []  # the last text, to which more blocks may belong

        def closed() -> Iterator[pa.RecordBatch]:
            if open_text is not None:
                ids = np.concatenate(parts)
                yield texts(open_text, [n_words], [0, len(ids)], ids)

        for batch in batches:
            words, rare, b = (batch.column(c) for c in ("words", "rare", "b"))
            first, others = starts(lengths(words)), rare.flatten()
            number = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy().copy()
            at = np.repeat(first[:-1] - b.to_numpy().astype(np.int64) * BLOCK_WORDS, lengths(rare)) + pc.struct_field(others, [0]).to_numpy()
            number[at] = len(known) + np.arange(len(others))
            if (number < 0).any():
                raise ValueError("a word has no ids")
            found = pa.concat_arrays([known_ids, pc.struct_field(others, [1]).cast(known_ids.type)]).take(pa.array(number))
            ids, edge = found.flatten().to_numpy(), starts(lengths(found))[first]
            begun = np.flatnonzero(b.to_numpy() == 0)
            lead = begun[0] if len(begun) else batch.num_rows
            n_words, parts = n_words + int(first[lead]), [*parts, ids[: edge[lead]]]
            if len(begun):
                yield from closed()
                last = begun[-1]
                if len(begun) > 1:
                    yield texts(batch.take(pa.array(begun[:-1])), np.diff(first[begun]), edge[begun] - edge[lead], ids[edge[lead] : edge[last]])
                open_text, n_words, parts = batch.slice(last, 1), int(first[-1] - first[last]), [ids[edge[last] :]]
        yield from closed()

    return frugal(run)


def vocabulary(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """word, n (occurrences), ids of every distinct word; stored in the shared folder."""
    spark = docs.sparkSession
    counted = docs.select(F.explode(words(F.col(text), pieces)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = store.materialize(counted.withColumn("wid", F.monotonically_increasing_id()), "words")
    # dealt out once: the grouping and the join above it keep that; a task's lattices fit in memory at any size
    dealt = counted.repartition(max(1, -(-counted.count() // TASK_WORDS)), "wid")
    by_word = edges(dealt, pieces).groupBy("wid").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    found = by_word.join(dealt, "wid").select("word", "n", best_ids(pieces)("word", "edges").alias("ids"))
    # a task has about TASK_WORDS groups, more than Spark would hold before it sorts instead
    with store.setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * TASK_WORDS)):
        known = store.materialize(found, "vocabulary")
    store.discard(counted)
    return known


def frequent_from(known: DataFrame, dictionary: int, dictionary_bytes: int) -> int:
    """The least n such that the words of n or more occurrences keep to both bounds together."""
    step = F.floor(F.log2("n") * 8).cast("int")  # at most 8 * 63 steps, whatever the data
    steps = known.groupBy(step.alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("words"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("bytes")).collect()
    n, all_words, all_bytes = 1 << 62, 0, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        all_words, all_bytes = all_words + row["words"], all_bytes + row["bytes"]
        if all_words > dictionary or all_bytes > dictionary_bytes:
            break
        n = row["n"]
    return n


def rows_apart(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """docs' key and text with a number that tells rows with one key apart, and the names of key and number."""
    nth = "nth" if key != "nth" else "_nth"
    return store.numbered(docs.select(F.col(key), F.col(text).alias("text" if key != "text" else "_text")), F.col(key), nth), [key, nth]


def blocks(all_words: Column, rare: Column) -> Column:
    """A text's words in blocks, each with the rare words that lie in it; a text without words has an empty one."""

    def cut(w: Column) -> Column:
        begun = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(BLOCK_WORDS))
        return F.transform(begun, lambda at: F.struct(F.slice(w, at + 1, F.lit(BLOCK_WORDS)).alias("words"), F.filter(rare, lambda x: (x["pos"] >= at) & (x["pos"] < at + BLOCK_WORDS)).alias("rare")))

    return F.flatten(F.transform(F.array(all_words), cut))  # in an array of one, so words are cut once


def gathered(docs: DataFrame, pieces: Pieces, keys: list[str], use: Callable[[DataFrame], DataFrame], text: str = "text", carry: tuple[str, ...] = (), dictionary: int = 1 << 17, dictionary_bytes: int = 1 << 23) -> DataFrame:
    """use(rows) of keys, carry, n_words, ids of every row, stored; keys are a column and a number that tells rows apart, and `use` works row by row.

    A text is dealt whole, and its frequent words are looked up and put together where it went; only other words are
    shuffled one by one. Texts are dealt in PARTS, one after the other, so no more of them are on the way at once."""
    spark = docs.sparkSession
    known = vocabulary(docs, pieces, text)
    store.release(spark)
    size = known.agg(F.sum(F.col("n") * F.octet_length("word"))).first()[0] or 0
    # with fewer than a join asks for, the texts put together would be shuffled again
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (PARTS * TASK_BYTES)))
    is_frequent = F.col("n") >= frequent_from(known, dictionary, dictionary_bytes)
    # half as many bytes on the way where the model's ids allow it
    narrow = "array<short>" if max([i for _, i, _ in pieces.rows] + [*pieces.bytes.values(), pieces.unknown]) < 1 << 15 else "array<int>"
    own = ["word", F.col("ids").cast(narrow).alias("ids")]
    frequent = store.materialize(known.where(is_frequent).select(*own), "frequent")
    # one column that is never null or constant: a join finds rows without a key, and no exchange follows where rows were dealt by it
    key, nth = map(F.col, keys)
    place = store.fresh(docs.columns, "p_") + "place"
    docs = docs.withColumn(place, F.concat(F.when(key.isNull(), "n").otherwise("k"), F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), nth.cast("string")))
    missing = docs.select(place, F.posexplode(words(F.col(text), pieces)).alias("pos", "word")).join(F.broadcast(frequent.select("word")), "word", "left_anti")
    rare = store.materialize(missing.join(known.where(~is_frequent).select(*own), "word").select(place, "pos", "ids"), "rare")
    store.discard(known)
    store.release(spark)
    kinds = StructType([docs.schema[k] for k in (*keys, *carry)]).add("n_words", LongType()).add("ids", ArrayType(IntegerType()))
    run = put_together(frequent.toArrow(), [*keys, *carry])
    done = []
    # a task's groups are bounded by TASK_BYTES, so they need no sort
    with store.setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(TASK_BYTES)), store.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS)):
        for part in range(PARTS):
            here = F.pmod(F.xxhash64(place), F.lit(PARTS)) == part
            others = rare.where(here).repartition(tasks, place).groupBy(place).agg(F.collect_list(F.struct("pos", "ids")).alias("r"))
            both = docs.where(here).repartition(tasks, place).join(others.hint("shuffle_hash"), place, "left")
            each = both.select(*keys, *carry, F.posexplode(blocks(words(F.col(text), pieces), F.col("r"))).alias("b", "block"))
            row = each.select(*keys, *carry, "b", "block.words", "block.rare").mapInArrow(run, kinds)
            done.append(store.materialize(use(row), "part"))
            store.release(spark)
    store.discard(frequent)
    store.discard(rare)
    return reduce(DataFrame.unionByName, done)


def encode(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids of every row."""
    docs, keys = rows_apart(docs, key, text)
    return gathered(docs, pieces, keys, lambda rows: rows.select(key, "ids"), docs.columns[1])


def spelt(pieces: Pieces) -> Callable[[str], Column]:
    """The bytes of lists of ids, one after the other."""
    raw = pieces.raw()

    def run(ids: pa.Array) -> pa.Array:
        flat = pc.fill_null(ids.flatten(), -1).to_numpy()
        if not len(flat):
            return pa.array([b""] * len(ids), pa.binary())
        taken = raw.take(pa.array(np.where((flat >= 0) & (flat < len(raw)), flat, len(raw) - 1)))
        bounds = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :][starts(lengths(ids))]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), taken.buffers()[2]])

    return arrow_udf(run, "binary", ArrowUDFType.SCALAR)


def summed(ids: pa.Array) -> pa.Array:
    totals = starts(ids.flatten().to_numpy())
    return pa.array(np.diff(totals[starts(lengths(ids))]), pa.int64())


def text_of(ids: str, pieces: Pieces) -> Column:
    """The text of a column of ids."""
    text = F.replace(F.decode(spelt(pieces)(ids), "utf-8"), F.lit(SPACE), F.lit(" "))
    return F.coalesce(F.substr(text, F.lit(2), F.char_length(text)), F.lit(""))


def decode(encoded: DataFrame, pieces: Pieces, key: str = "doc_id") -> DataFrame:
    """key, text from key, ids, row by row."""
    return encoded.select(key, text_of("ids", pieces).alias("text"))


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Of every row, encoded and decoded as a whole: doc_id, n_words, n_pieces, ids_sum, ids_print (hash of all its ids in order), decoded_chars, and whether the text decoded from its ids has the hash of its own, with `▁` as spaces."""
    pieces = Pieces(model)
    docs, keys = rows_apart(docs, "doc_id", "text")
    own = F.xxhash64(F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" ")))

    def measured(rows: DataFrame) -> DataFrame:
        both = rows.withColumns({"ids_sum": arrow_udf(summed, "long", ArrowUDFType.SCALAR)("ids"), "decoded": text_of("ids", pieces)})
        return both.select(
            "doc_id",
            "n_words",
            F.size("ids").cast("long").alias("n_pieces"),
            "ids_sum",
            F.xxhash64("ids").alias("ids_print"),
            F.char_length("decoded").cast("long").alias("decoded_chars"),
            (F.xxhash64("decoded") == F.col("text_print")).alias("decodes"),
        )

    return gathered(docs.withColumn("text_print", own), pieces, keys, measured, carry=("text_print",))
