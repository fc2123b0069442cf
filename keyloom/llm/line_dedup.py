"""Line deduplication as an exact set-similarity join, with DataFrame functions only.

A line's tokens are the distinct hashes of its five-word shingles (one token for a shorter
line). Lines with equal text fall together first. Two lines of Jaccard similarity t or more
share l tokens among their first n - ceil(t n) + l in any order of the tokens (prefix filter). First
the order is by hash and l is 4, or all that the line must share if that is less: lines without as
many prefix tokens that another line of like size has too are done, which leaves few but near copies. For the
lines left whole sets are made and their tokens counted over all of these; the order then is by that
count, rarest first, and l is 1, so tokens that many lines have by chance or in a common passage make no
pairs. Pairs have like sizes (length filter), and at their first common token enough tokens left
(positional filter). Pairs that pass are verified on the whole token sets. A line goes if an earlier
line (smaller doc_id, then row, then position) is as similar, whether or not that one is removed itself.

Defined cases: null text stays null; lines without words are kept and never matched; words are
`[^\\x20\\x09-\\x0D]+`. Rows that share a doc_id are documents of their own, one after the other;
rows with a null doc_id are returned untouched. Extra columns are kept; n_chars is counted anew. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import store

SHINGLE = 5
COMMON = 4  # shared prefix tokens asked of a line before its whole set is made


ODD = (" ", "\t", "\x0b", "\f", "\r")
LINE = ["doc_id", "nth", "pos"]


def words(line: Column) -> Column:
    """The words of a line that has one. Words between single spaces are cut without a pattern, which is ten times faster."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in ODD[1:]:
        odd = odd | line.contains(c)
    return F.when(odd, F.split(F.btrim(line, F.lit("".join(ODD))), "[ \\t\\x0B\\f\\r]+")).otherwise(F.split(line, " "))


def is_solid(line: Column) -> Column:
    return F.char_length(F.btrim(line, F.lit("".join(ODD)))) > 0


def lines_of(docs: DataFrame, key: str, text: str, nth: str) -> DataFrame:
    """doc_id, nth, pos (0-based), line: every line with a word of every text."""
    each = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(nth).alias("nth"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return each.where(is_solid(F.col("line")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(line: Column) -> Column:
    """Distinct hashes of the shingles of a line's words."""

    def of(split: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(split) - SHINGLE)
        runs = F.transform(at, lambda i: F.xxhash64(*[F.get(split, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(split) >= SHINGLE, runs).otherwise(F.array(F.xxhash64(F.concat_ws(" ", split))))

    return F.array_distinct(let(words(line), of))  # outside of let, where it is compiled


def ordered_tokens(lines: DataFrame) -> DataFrame:
    """The line's id, n and t: its tokens in the order of their hashes."""
    return lines.select("id", F.sort_array(tokens(F.col("line"))).alias("t")).withColumn("n", F.size("t"))


def least_shared(n: Column, percent: int) -> Column:
    """Tokens that a line of n has in common with any similar line, at least."""
    return F.ceil(n * percent / 100).cast("int")


def promising(lines: DataFrame, percent: int) -> DataFrame:
    """Ids of the lines that share as many tokens of a prefix with lines of like size as similar lines do; the prefix is longer by one for each further token."""
    needed = least_shared(F.col("n"), percent)
    asked = F.least(F.lit(COMMON), needed)
    each = ordered_tokens(lines).select("id", "n", F.explode(F.slice("t", F.lit(1), F.col("n") - needed + asked)).alias("token"))
    met = each.withColumn("held", F.count("*").over(Window.partitionBy("token"))).where("held > 1")
    by_size = Window.partitionBy("token").orderBy("n")  # if any other line is of like size, one of the two next to this one is
    alike_sized = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    met = met.withColumn("sized", alike_sized).where("sized")
    return met.groupBy("id").agg(F.count("*").alias("met"), F.min("n").alias("n")).where(F.col("met") >= asked).select("id")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, the line's place, n (tokens of the line), i (the token's rank in its order) for each prefix token that two or more of the lines have.

    The order is by the number of lines that have the token, then by hash. Tokens of one line alone come first; a line that has so many of them that its prefix ends there can't be similar to any."""
    each = sets.select(*LINE, F.size("t").alias("n"), F.explode("t").alias("token"))
    met = each.withColumn("held", F.count("*").over(Window.partitionBy("token"))).where("held > 1")
    rare = met.groupBy(*LINE, "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("t"))
    alone = F.col("n") - F.size("t")
    size = F.size("t") - least_shared(F.col("n"), percent) + 1
    cut = rare.where(size > 0).select(*LINE, "n", alone.alias("alone"), F.posexplode(F.slice("t.token", F.lit(1), size)).alias("i", "token"))
    return cut.select(*LINE, "n", (F.col("alone") + F.col("i")).alias("i"), "token")


def similar_lines(lines: DataFrame, percent: int = 75) -> DataFrame:
    """Places of the lines that have an earlier line as similar. lines: a stored table of ids, places and line, without equal texts; it is deleted."""
    spark = lines.sparkSession
    hopeful = store.materialize(promising(lines, percent), "promising")
    store.release(spark)
    sets = store.materialize(lines.join(hopeful.hint("shuffle_hash"), "id").select(*LINE, tokens(F.col("line")).alias("t")), "sets")
    store.discard(lines)
    store.discard(hopeful)
    store.release(spark)
    shared = store.materialize(prefixes(sets, percent), "shared")
    store.release(spark)
    # each token's earliest line is its head: one candidate a token settles most lines of a large group
    heads = store.materialize(shared.groupBy("token").agg(F.min(F.struct(*LINE, "n", "i")).alias("h")).select("token", "h.*"), "heads")
    headed = store.materialize(candidates(heads, shared, percent), "headed")
    # of a line's heads the one with most prefix tokens in common comes first
    first = headed.groupBy(*named("b")).agg(F.max_by(F.struct(*named("a")), F.struct("common", *named("a"))).alias("head"))
    first = store.materialize(first.select("head.*", *named("b")), "first")
    settled = verified(first, sets, percent)
    # then the other heads of the lines that are still open
    others = headed.select(*named("a"), *named("b")).join(settled.withColumnsRenamed({c: f"{c}_b" for c in LINE}), named("b"), "left_anti")
    by_others = verified(others.join(first, [*named("a"), *named("b")], "left_anti"), sets, percent)
    store.release(spark)
    known = settled.unionByName(by_others)
    # at last every earlier line that shares a token; only tokens that an open line has can make pairs
    open_lines = store.materialize(shared.join(known, LINE, "left_anti"), "open")
    rest = candidates(shared.join(open_lines.select("token").distinct(), "token", "left_semi"), open_lines, percent)
    by_rest = verified(possible(rest.join(headed, [*named("a"), *named("b")], "left_anti"), shared, percent), sets, percent)
    found = store.materialize(known.unionByName(by_rest).distinct(), "similar")
    for table in (shared, heads, headed, first, sets, settled, by_others, open_lines, by_rest):
        store.discard(table)
    return found


def named(side: str) -> list[str]:
    return [f"{c}_{side}" for c in LINE]


def alike(percent: int) -> Column:
    sizes = F.size("t_a") + F.size("t_b")
    return let(F.size(F.array_intersect("t_a", "t_b")), lambda common: 100 * common >= percent * (sizes - common))


def candidates(a: DataFrame, b: DataFrame, percent: int) -> DataFrame:
    """Pairs of lines whose prefix rows share a token that can be their first common one, by order, length and place, with the number of such tokens."""
    a, b = a.alias("a"), b.alias("b")
    earlier = F.struct(*[F.col(f"a.{c}") for c in LINE]) < F.struct(*[F.col(f"b.{c}") for c in LINE])
    sizes = (100 * F.col("a.n") >= percent * F.col("b.n")) & (100 * F.col("b.n") >= percent * F.col("a.n"))
    # |x & y| >= t / (1 + t) * (|x| + |y|); at the first common token that one and the shorter rest are left
    rest = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    can_be_first = (100 + percent) * rest >= percent * (F.col("a.n") + F.col("b.n"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & earlier & sizes & can_be_first)
    return met.groupBy(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in LINE]).agg(F.count("*").alias("common"))


def possible(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The pairs that can be similar by the number of tokens that their whole prefixes have in common."""
    whole = shared.groupBy(*LINE, "n").agg(F.collect_list("token").alias("p"))
    for side in "ab":
        pairs = pairs.join(whole.withColumnsRenamed({c: f"{c}_{side}" for c in [*LINE, "n", "p"]}), named(side))
    # of two prefixes the one that ends at the rarer token has met all its matches; the rest of that line is no longer than this
    behind = least_shared(F.greatest("n_a", "n_b"), percent) - 1
    common = F.size(F.array_intersect("p_a", "p_b"))
    return pairs.where((100 + percent) * (common + behind) >= percent * (F.col("n_a") + F.col("n_b"))).select(*named("a"), *named("b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Places of the later lines of the pairs that are similar on their whole sets; stored."""
    pairs = found = store.materialize(pairs, "pairs")
    for side in "ab":
        found = found.join(sets.select(*LINE, "t").withColumnsRenamed({c: f"{c}_{side}" for c in [*LINE, "t"]}), named(side))
    found = store.materialize(found.where(alike(percent)).select(*[F.col(f"{c}_b").alias(c) for c in LINE]).distinct(), "verified")
    store.discard(pairs)
    return found


def kept_lines(docs: DataFrame, percent: int, key: str, text: str, nth: str) -> DataFrame:
    """Places of the lines with a word that stay; stored."""
    prints = [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")]
    first = lines_of(docs, key, text, nth).groupBy(*prints).agg(F.min(F.struct(*LINE, "line")).alias("f")).select("f.*").withColumn("id", F.monotonically_increasing_id())
    first = store.materialize(first, "lines")
    store.release(docs.sparkSession)
    places = store.materialize(first.select(*LINE), "places")
    later = similar_lines(first, percent)
    kept = store.materialize(places.join(later, LINE, "left_anti"), "kept")
    store.discard(places)
    store.discard(later)
    store.release(docs.sparkSession)
    return kept


def dedup_lines(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines that stay, and `l_lines` and `l_removed` (lines with words, before and gone; a longer prefix if a column has that one)."""
    names, p = docs.columns, store.fresh(docs.columns, "l_")
    docs = store.numbered(docs, F.col(key), f"{p}nth")
    stay = kept_lines(docs, percent, key, text, f"{p}nth")
    places = stay.groupBy("doc_id", "nth").agg(F.collect_list("pos").alias(f"{p}pos")).withColumnsRenamed({"doc_id": f"{p}id", "nth": f"{p}no"})
    joined = docs.join(places, (F.col(key) == F.col(f"{p}id")) & (F.col(f"{p}nth") == F.col(f"{p}no")), "left")
    known = F.col(key).isNotNull() & F.col(text).isNotNull()
    none = F.array().cast("array<int>")
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    joined = joined.withColumn(f"{p}all", split).withColumn(f"{p}pos", F.coalesce(f"{p}pos", none))
    each = F.sequence(F.lit(0), F.size(f"{p}all") - 1)
    joined = joined.withColumn(f"{p}blank", F.filter(each, lambda i: ~is_solid(F.get(f"{p}all", i))))
    stays = F.transform(F.sort_array(F.concat(f"{p}pos", f"{p}blank")), lambda i: F.get(f"{p}all", i))
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(f"{p}all") - F.size(f"{p}blank")).cast("long")
    removed = F.when(known, lines - F.size(f"{p}pos")).otherwise(0).cast("long")
    out = joined.withColumns({f"{p}lines": lines, f"{p}removed": removed})
    out = out.withColumn(text, F.when(F.col(f"{p}removed") > 0, F.array_join(stays, "\n")).otherwise(F.col(text)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(f"{p}removed") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names, f"{p}lines", f"{p}removed")


def digest(docs: DataFrame, percent: int = 75) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"), percent)
    return out.select("doc_id", F.col("l_lines").alias("n_lines"), F.col("l_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without their repeated lines; a document all of whose lines went is dropped, an empty one stays."""
    p = store.fresh(docs.columns, "l_")
    out = dedup_lines(docs, percent)
    return out.where((F.col(f"{p}removed") == 0) | (F.col(f"{p}removed") < F.col(f"{p}lines"))).select(*docs.columns)
