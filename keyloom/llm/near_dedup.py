"""MinHash near-deduplication with odd sketches.

1. A text's set is the distinct hashes of its five-word shingles. 128 MinHash samples give 32
   bands of four; the samples are also folded into a 512-bit parity bitmap, the odd sketch,
   whose XOR population count estimates the similarity of two texts. A second parity bitmap, of
   the whole set, bounds it: a bit differs only through a shingle that one text alone has.
2. Texts with equal sets become one representative. Within a band bucket every member is
   paired with the bucket's smallest id only; a pair survives if the odd sketches allow the
   similarity, and becomes a link if the full sets confirm it.
3. Components of those links are found by alternating stars. Buckets that still hold several
   components get newly drawn heads once; then the members of what buckets still hold several are
   joined on their rarest shingles across components, and those pairs go through the sketches and
   the full sets as well. So no link is lost to the star shape, and pairs are made only between
   components that nearly reach the similarity.

A pair of similarity 0.75 meets in no band with probability 5e-6. A sketch of samples lets
pass everything whose estimate is within six standard deviations of the threshold; the bitmap of
the whole set and the sizes drop only pairs that can't reach it.

Defined cases: null, empty or wordless texts have an empty set and link with nothing. One to
four words make one shingle. Repeated rows with one doc_id are
each returned and share a component. Rows with a null doc_id link with nothing: no component, kept. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import store
from keyloom.llm.bytetext import column_bytes, mix, row_groups, shingle_hashes, span_hashes, word_spans
from keyloom.llm.workers import frugal

SHINGLE, BANDS, ROWS, BITS = 5, 32, 4, 512
ROUNDS = 1  # of newly drawn heads before the buckets' rest is joined on rare shingles
SAMPLES = BANDS * ROWS
_rng = np.random.default_rng(20240717)
MULTIPLY = _rng.integers(1, 1 << 63, (SAMPLES, 1), dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, (SAMPLES, 1), dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for group in row_groups(column):
        data, offsets = column_bytes(group)
        data = lower_ascii(data)
        starts, ends = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        cut = np.searchsorted(starts, offsets)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = words[a:b]
            yield np.unique(shingle_hashes(own, min(SHINGLE, len(own)))) if len(own) else own


def parity(bits: np.ndarray) -> np.ndarray:
    """The parity bitmap of bit numbers, as 64-bit words."""
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, odd sketch as eight 64-bit words)."""
    with np.errstate(over="ignore"):
        low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 2048):
            low = np.minimum(low, (MULTIPLY * found[None, at : at + 2048] + ADD).min(axis=1))
        bits = mix(low ^ PLACE) % np.uint64(BITS)
        odd = parity(bits)
        keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for row in low.reshape(BANDS, ROWS).T:
            keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + row)
    return keys.view(np.int64), odd


def most_differing_bits(similarity: float, deviations: float = 6.0) -> int:
    """The largest XOR population count that the similarity still explains."""
    differing = 2 * SAMPLES * (1 - similarity)
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** differing)
    spread = 2 * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    return int(expected + deviations * (spread**2 + BITS / 16) ** 0.5)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint, band keys, odd sketch and whole parity bitmap of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, bands, odds, wholes = [], [], [], [], [], []
            for found in shingle_sets(batch.column(1)):
                n.append(len(found))
                with np.errstate(over="ignore"):
                    print_one = mix(found).sum(dtype=np.uint64)
                    print_two = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                one.append(int(print_one.astype(np.int64)))
                two.append(int(print_two.astype(np.int64)))
                keys, odd = signature(found) if len(found) else (None, None)
                bands.append(keys)
                odds.append(odd)
                wholes.append(parity(found % np.uint64(BITS)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64())), pa.array(wholes, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "print_one", "print_two", "bands", "odd", "whole"],
            )

    one_each = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return one_each.mapInArrow(frugal(run), "doc_id long, n_shingles long, print_one long, print_two long, bands array<long>, odd array<long>, whole array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            for side in (0, 1):
                first = {k: i for i, k in reversed([*enumerate(ids[side])]) if k not in seen}
                sets = shingle_sets(batch.column(2 + side).take(pa.array(first.values(), pa.int64())))
                seen |= dict(zip(first, sets, strict=True))
            keep = []
            for a, b in zip(*ids, strict=True):
                both = len(np.intersect1d(seen[a], seen[b], assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(seen[a]) + len(seen[b]) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id"), "text")
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def rare_pairs(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (id, component) of different components that may be as similar; every pair that is, is among them.

    Shingles are ordered by the number of members that have them. A text of n shingles shares one of its first
    n - ceil(2t / (1 + t) n) + 1 with one of the first n - ceil(t n) + 1 of any text as similar and no shorter. Texts that have
    less than that in common, as those made from one template, differ in all of these, so they make no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([found.view(np.int64) for found in shingle_sets(batch.column(2))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sets], names=["id", "component", "t"])

    texts = members.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").dropDuplicates(["id"])
    sets = texts.select("id", "component", "text").mapInArrow(frugal(run), "id long, component long, t array<long>")
    each = store.materialize(sets.select("id", "component", F.size("t").cast("long").alias("n"), F.explode("t").alias("token")), "shingles")
    held = each.groupBy("token").agg(F.count("*").alias("held"), (F.min("component") < F.max("component")).alias("crosses"))
    order = Window.partitionBy("id").orderBy("held", "token")
    ranked = each.join(held, "token").withColumn("i", F.row_number().over(order)).where("crosses")
    rest = F.col("n") - F.col("i") + 1  # tokens from this one on
    prefix = store.materialize(ranked.where(100 * rest >= percent * F.col("n")).select("id", "component", "n", "token", rest.alias("rest")), "prefix")
    store.discard(each)
    a, b = prefix.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("n")).alias("a"), prefix.alias("b")
    no_shorter = F.struct("a.n", "a.id") < F.struct("b.n", "b.id")
    enough = (100 + percent) * F.least("a.rest", "b.rest") >= percent * (F.col("a.n") + F.col("b.n"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & no_shorter & enough)
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a < b): large and small stars in turn, until nothing changes."""
    edges = store.materialize(edges.select("a", "b").distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store.materialize(both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = store.materialize(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        before, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return store.materialize(edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots), "components")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after new links (a, b) between them."""
    if links.isEmpty():
        return found
    label = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    joined = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")).where("x <> y")
    over = components(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    single = links.selectExpr("explode(array(a, b)) as id").distinct().join(found, "id", "left_anti").selectExpr("id", "id as component")
    every = found.unionByName(single).join(over.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    return store.materialize(every.select("id", F.coalesce("top", "component").alias("component")), "components")


def cluster(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    most = most_differing_bits(percent / 100)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signs = store.materialize(sketches(docs), "sketches")
    small = signs.select("doc_id", "n_shingles", "print_one", "print_two").where("n_shingles > 0 and doc_id is not null")
    prints = ["print_one", "print_two", "n_shingles"]
    groups = store.materialize(small.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "groups")
    reps = signs.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    heads = store.materialize(banded.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "heads")
    members = store.materialize(banded.join(heads, "key").select("key", "id", "head"), "members")
    sketch = store.materialize(reps.select(F.col("doc_id").alias("id"), F.struct("odd", "whole", F.col("n_shingles").alias("n")).alias("s")), "sketch")
    differing = lambda name: sum((F.bit_count(F.col(f"s_a.{name}")[i].bitwiseXOR(F.col(f"s_b.{name}")[i])) for i in range(BITS // 64)), F.lit(0))
    # sets that similar differ in at most (1 - t) / (1 + t) of their sizes' sum
    room = (100 - percent) * (F.col("s_a.n") + F.col("s_b.n"))
    possible = ((100 + percent) * F.abs(F.col("s_a.n") - F.col("s_b.n")) <= room) & (differing("odd") <= most) & ((100 + percent) * differing("whole") <= room)

    def screened(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sketch.withColumnsRenamed({"id": "a", "s": "s_a"}), "a")
        return left.join(sketch.withColumnsRenamed({"id": "b", "s": "s_b"}), "b").where(possible).select("a", "b")

    star = store.materialize(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = store.materialize(confirm(store.materialize(screened(star), "screened"), docs, percent), "linked")
    found = components(links)

    def mixed_members(found: DataFrame) -> DataFrame | None:
        """Members (key, id, component) of buckets that still hold several components; null if there is none."""
        labelled = members.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        labelled = store.materialize(labelled, "labelled")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        mixed = store.materialize(mixed.select("key"), "mixed")
        return None if mixed.isEmpty() else store.materialize(labelled.join(mixed, "key"), "inside")

    # heads drawn anew, so that members of a component that don't reach the first head meet others of it: pairs stay linear
    asked = star
    for turn in range(ROUNDS):
        inside = mixed_members(found)
        if inside is None:
            break
        drawn = inside.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn))).alias("h"))
        drawn = store.materialize(drawn.select("key", F.col("h.id").alias("head"), F.col("h.component").alias("of_head")), "drawn")
        met = inside.join(drawn, "key").where("component <> of_head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
        pairs = store.materialize(met.join(asked, ["a", "b"], "left_anti"), "pairs")
        asked = asked.unionByName(pairs)
        found = merged(found, store.materialize(confirm(store.materialize(screened(pairs), "screened"), docs, percent), "linked"))

    # what is left is joined on its rarest shingles, so that no link is missed and pairs far below one are not made
    inside = mixed_members(found)
    if inside is not None:
        met = rare_pairs(inside.select("id", "component").distinct(), docs, percent)
        pairs = store.materialize(screened(met).join(asked, ["a", "b"], "left_anti"), "pairs")
        found = merged(found, store.materialize(confirm(pairs, docs, percent), "linked"))
    classes = groups.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*prints, F.coalesce("component", "rep").alias("component_id"))
    plain = signs.select("doc_id", *prints)
    out = plain.join(classes, prints, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that represent their component, with docs' own columns: one each, also where rows share a doc_id. Rows without one stay."""
    unlinked = docs.where("doc_id is null")
    names, p = docs.columns, store.fresh(docs.columns, "n_")
    nth = f"{p}nth"
    docs = store.numbered(docs.where("doc_id is not null"), F.col("doc_id"), nth)
    if docs.where(F.col(nth) > 0).isEmpty():
        return docs.join(cluster(docs, percent).where("kept").select("doc_id"), "doc_id", "left_semi").select(*names).unionByName(unlinked)
    # rows are clustered by their numbers; of a component the row with the least doc_id and number stays
    judged = cluster(docs.select(F.col(nth).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias(nth), F.col("component_id").alias(f"{p}of"))
    first = docs.select("doc_id", nth).join(judged, nth).groupBy(f"{p}of").agg(F.min(F.struct("doc_id", nth)).alias("first"))
    return docs.join(store.materialize(first.select(f"first.{nth}"), "first"), nth, "left_semi").select(*names).unionByName(unlinked)
