import random

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import sentencepiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.Pieces("piece_bpe_32k.model")


def test_texts_of_many_blocks_are_whole_whatever_the_batches(spark, pieces, monkeypatch):
    """Blocks of two words and batches of one to five blocks: texts end at, before and behind a batch's end."""
    monkeypatch.setattr(sentencepiece, "BLOCK_WORDS", 2)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "thing", "日本", "x" * 70, "\n", "zq%d" % i]) for _ in range(rng.randrange(14))) for i in range(40)]
    known = sorted({w for t in texts for w in t.split(" ")})
    ids = {w: [i, -i][: 1 + i % 2] for i, w in enumerate(known)}
    common = [w for w in known if not w.startswith("zq")]
    frequent = pa.table({"word": common, "ids": pa.array([ids[w] for w in common], pa.list_(pa.int16()))})
    blocks = []
    for k, t in enumerate(texts):
        words = t.split(" ") if k % 5 else []
        for b in range(max(1, -(-len(words) // 2))):
            here = words[2 * b : 2 * b + 2]
            blocks.append({"doc_id": k, "b": b, "words": here, "rare": [{"pos": 2 * b + j, "ids": ids[w]} for j, w in enumerate(here) if w.startswith("zq")]})
    kind = pa.schema({"doc_id": pa.int64(), "b": pa.int32(), "words": pa.list_(pa.string()), "rare": pa.list_(pa.struct({"pos": pa.int32(), "ids": pa.list_(pa.int16())}))})
    want = [(k, len(w), [i for x in w for i in ids[x]]) for k, t in enumerate(texts) for w in [t.split(" ") if k % 5 else []]]
    for size in (1, 2, 3, 5, len(blocks)):
        batches = [pa.RecordBatch.from_pylist(blocks[i : i + size], schema=kind) for i in range(0, len(blocks), size)]
        got = [r for x in sentencepiece.put_together(frequent, ["doc_id"])(iter(batches)) for r in x.to_pylist()]
        assert [(r["doc_id"], r["n_words"], r["ids"]) for r in got] == want


def test_fold_takes_the_best_path_and_breaks_ties(pieces):
    """Equal totals go to the longer last piece, then to the smaller id; a character without a piece falls back to its bytes."""
    edge = lambda end, n, i: end << 32 | 255 - n << 24 | i
    none = sentencepiece.NO_PIECE
    lattices = [("ab", [edge(1, 1, 0), edge(2, 2, 2), edge(2, 1, 1)]), ("é", [edge(1, 1, none)]), ("aéb", [edge(1, 1, 0), edge(2, 1, none), edge(3, 1, 1)]), ("ab", [edge(1, 1, 0), edge(2, 2, 3), edge(2, 2, 4), edge(2, 1, 1)])]
    scores = np.array([-1.0, -1.0, -2.0, -3.0, -3.0, -9.0])
    words, edges = pa.array([w for w, _ in lattices]), pa.array([sorted(e) for _, e in lattices], pa.list_(pa.int64()))
    ids, sizes = sentencepiece.fold(words, edges, scores, [1000 + b for b in range(256)], 7)
    raw = [1000 + b for b in "é".encode()]
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == [2]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[2], raw, [0, *raw, 1], [0, 1]]
    assert sentencepiece.fold(words, edges, scores, None, 7)[0].tolist() == [2, 7, 0, 7, 1, 0, 1]


def test_neither_fold_nor_texts_go_through_word_by_word_sql(spark, pieces):
    """The dear parts before: an aggregate over edges, and a list of the words of each text put together by rows."""
    docs = spark.createDataFrame([(1, "hello rare words " * 3000), (2, None)], "doc_id long, text string")
    every, keys = sentencepiece.rows_apart(docs, "doc_id", "text")
    plans = []
    found = sentencepiece.gathered(every, pieces, keys, lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or rows, dictionary=2).collect()
    assert all("MapInArrow" in p and "collect_list" not in p.split("Generate posexplode")[0] for p in plans)
    one = sentencepiece.encode(spark.createDataFrame([(1, "hello rare words ")], "doc_id long, text string"), pieces).first().ids
    long = next(r for r in found if r.doc_id == 1)
    space = next(i for p, i, _ in pieces.rows if p == sentencepiece.SPACE)
    assert one[-1] == space and long.n_words == 9001 and list(long.ids) == one[:-1] * 3000 + [space] and next(r.ids for r in found if r.doc_id == 2) == []


def test_only_substrings_that_can_be_pieces_are_cut(spark, pieces):
    """The edges are those of every substring, from fewer of them; bytes and sums are of all ids, known or not."""
    F, words = sentencepiece.F, ["▁international", "日本語", "x" * 150, "\n", "▁▁the", "a"]
    distinct = spark.createDataFrame(list(enumerate(words)), "wid long, word string")
    ids = {p: i for p, i, _ in pieces.rows}
    want = sorted((w, (i + n) << 32 | 255 - n << 24 | ids.get(x[i : i + n], sentencepiece.NO_PIECE)) for w, x in enumerate(words) for i in range(len(x)) for n in range(1, min(pieces.longest, len(x) - i) + 1) if n == 1 or x[i : i + n] in ids)
    found = sentencepiece.edges(distinct, pieces)
    assert sorted((r.wid, r.edge) for r in found.collect()) == want
    assert "sizes" in found._jdf.queryExecution().analyzed().toString()
    lists = [[ids["▁the"], 1 << 20, ids["a"]], [], [-1], [pieces.bytes[195], pieces.bytes[169], ids["▁"]], None]
    some = spark.createDataFrame([(x,) for x in lists], "ids array<int>").coalesce(1)
    got = some.select(sentencepiece.spelt(pieces)("ids").alias("raw"), F.array_size("ids").alias("n")).collect()
    assert [bytes(r.raw) for r in got] == [b"\xe2\x96\x81thea", b"", b"", b"\xc3\xa9\xe2\x96\x81", b""]
    assert sentencepiece.summed(pa.array([[1, 2], [], [1 << 30, 1 << 30, 1 << 30]], pa.list_(pa.int32()))).to_pylist() == [3, 0, 3 << 30]
