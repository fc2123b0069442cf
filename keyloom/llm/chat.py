"""Chat formatting of reply trees with DataFrame functions only.

Nodes point to their parents. Self-joins double the reach of each node's pointer, and paths
from the leaves grow by the doubled pointers, so trees of any depth take logarithmically many
joins. Branches are ranked by the summed score of their path; each chosen path is formatted as
one conversation.

Template of a turn: `<|turn|>` role `\\n` text `<|end|>` and a line break. In roles and texts
`&`, `<` and `[` become `&amp;`, `&lt;` and `&#91;`, so no control string survives inside them and the
change can be undone; a line break in a role becomes `&#10;`. The loss mask holds, for each turn, the place and length of its text in
the formatted string (null for turns that aren't the assistant's).

Defined cases: null text and null role are empty; turns are ordered by turn (nulls first), then
role and text, and repeated rows stay repeated turns; a null conv_id is a conversation of its own.
Extra columns are ignored. An empty table gives an empty table. A parent that isn't there makes
its child a root; a cycle of parents has no leaf and is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import store

TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def as_tree(turns: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn answers the one before it.

    Columns: tree, node, parent, role, text, score. Numbers come from one sort of each conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    nth = F.row_number().over(order).cast("long")
    out = turns.select(F.col("conv_id").alias("tree"), nth.alias("node"), "role", "text")
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, steps): every node on the way from each leaf to its root; steps counts from the leaf."""
    ids = nodes.select("tree", "node", "parent")
    present = ids.select(F.col("tree").alias("t"), F.col("node").alias("parent_node")).distinct()
    ids = ids.join(present, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("parent_node")), "left")
    jump = store.materialize(ids.select("tree", "node", F.col("parent_node").alias("up")), "jump")
    has_child = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = jump.join(has_child, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    found = store.materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps")), "paths")
    reach, parts = 1, [found]
    while True:
        step = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        so_far = parts[0]
        for part in parts[1:]:
            so_far = so_far.unionByName(part)
        grown = so_far.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("steps") + reach).alias("steps"))
        grown = store.materialize(grown, "paths")
        if grown.isEmpty():
            return so_far
        parts.append(grown)
        # only nodes whose pointer still leads somewhere are kept: a long tree alone goes on
        over = step.select(F.col("t"), F.col("n"), F.col("up").alias("further"))
        jump = store.materialize(jump.where("up is not null").join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("further").alias("up")), "jump")
        reach *= 2


def choose(nodes: DataFrame, found: DataFrame, best: int | None = None) -> DataFrame:
    """found with the rank of each leaf's path in its tree (by summed score, ties to the smaller leaf), the `best` ones only."""
    scores = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    summed = found.join(scores, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
    ranked = summed.withColumn("path_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("path_score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("path_rank") <= best)
    ranked = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "path_score", "path_rank")
    return found.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).drop("t", "l")


def format_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, path_rank, path_score, formatted and loss (array of (at, size) for each turn, 0-based code points)."""
    chosen = choose(nodes, paths(nodes), best)
    texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learnt"))
    turns = chosen.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    sizes = turns.select("tree", "leaf", "path_rank", "path_score", (-F.col("steps")).alias("at"), F.concat("head", "body", F.lit(END)).alias("said"), F.char_length("head").cast("long").alias("head_size"), F.when(F.col("learnt"), F.char_length("body").cast("long")).alias("body_size"))
    whole = F.char_length("said").cast("long")
    before = F.sum(whole).over(Window.partitionBy("tree", "leaf").orderBy("at")) - whole
    span = F.when(F.col("body_size").isNotNull(), F.struct((before + F.col("head_size")).alias("at"), F.col("body_size").alias("size")))
    placed = sizes.select("tree", "leaf", "path_rank", "path_score", "at", "said", span.alias("span"))
    gathered = placed.groupBy("tree", "leaf", "path_rank", "path_score").agg(F.sort_array(F.collect_list(F.struct("at", "said", "span"))).alias("turns"))
    return gathered.select("tree", "leaf", "path_rank", "path_score", F.array_join("turns.said", "").alias("formatted"), F.col("turns.span").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with its turns (array of (role, text)) and the texts under the loss mask, both taken from the string."""
    said = F.slice(F.split("formatted", "<\\|turn\\|>"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.char_length(head) + 2, F.char_length(x) - F.char_length(head) - 1 - len(END))
        return F.struct(unescape(F.replace(head, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    one = formatted.withColumn("turns", F.transform(said, turn))
    # the mask is cut out of the pieces by its own places: piece by piece, so a long conversation is read once
    cut = one.select("*", F.posexplode_outer(F.arrays_zip(said.alias("said"), F.col("loss").alias("span"))).alias("nth", "both")).select("tree", "leaf", "nth", F.col("both.said").alias("said"), F.col("both.span").alias("span"))
    whole = F.char_length("said").cast("long") + len(TURN)
    start = F.sum(whole).over(Window.partitionBy("tree", "leaf").orderBy("nth")) - whole + len(TURN)
    under = F.when(F.col("span").isNotNull(), F.substr("said", (F.col("span.at") - F.col("start") + 1).cast("int"), F.col("span.size").cast("int")))
    learnt = cut.withColumn("start", start).select("tree", "leaf", "nth", under.alias("under")).where("under is not null")
    joined = learnt.groupBy("tree", "leaf").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "under"))), lambda x: unescape(x["under"])), "").alias("learnt"))
    joined = joined.withColumnsRenamed({"tree": "t", "leaf": "l"})
    return one.join(joined, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left").drop("t", "l").withColumn("learnt", F.coalesce("learnt", F.lit("")))


def digest(conversations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row for each conversation, read back from its formatted string."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    if extra is not None:
        turns = turns.unionByName(extra)
    nodes = store.materialize(as_tree(turns), "nodes")
    formatted = store.materialize(format_paths(nodes), "formatted")
    back = read_back(formatted)
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
