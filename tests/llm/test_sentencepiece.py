import random
import unicodedata

import pytest
from test_operators import docs, texts  # noqa: F401

from keyloom.llm import sentencepiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.Pieces("piece_bpe_32k.model")


def segment(text, pieces, score, ids):
    """Ids of the best path through the whole marked text, without cutting it into words."""
    x = "▁" + text.replace(" ", "▁")
    best = [(0.0, 0, 0)]
    for end in range(1, len(x) + 1):
        options = []
        for n in range(min(end, pieces.longest), 0, -1):
            p = x[end - n : end]
            if p in score:
                options.append((best[end - n][0] + score[p], n, p))
            elif n == 1:
                options.append((best[end - 1][0] + pieces.least - sentencepiece.UNKNOWN_PENALTY, 1, p))
        best.append(max(options, key=lambda o: o[0]))
    out, end = [], len(x)
    while end:
        p = best[end][2]
        out.append([ids[p]] if p in ids else [pieces.bytes[b] for b in p.encode()])
        end -= best[end][1]
    return [i for part in reversed(out) for i in part]


def test_ids_equal_brute_force_over_whole_texts(spark, docs, pieces):  # noqa: F811
    """Totals of the whole text may round otherwise than a word's, so equal scores are compared, not only equal ids."""
    score, ids = {p: s for p, _, s in pieces.rows}, {p: i for p, i, _ in pieces.rows}
    by_id = {i: s for _, i, s in pieces.rows}
    rng = random.Random(3)
    more = [(100, "a" * 5000), (100, "a" * 5000), (100, "other"), (None, "hello world"), (None, None), (101, "日本語12.5é\u0301, x\n\n y"), (102, "".join(rng.choice("aeinrst'-1日 \n") for _ in range(3000)))]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted((i, segment(t, pieces, score, ids) if t else []) for i, t in [*((i if i is not None else -1, t) for i, t in [*enumerate(texts()), *more])])
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in sentencepiece.encode(every, pieces).collect())
    weight = lambda ids: sum(by_id.get(i, -100.0) for i in ids)
    assert [(i, len(x)) for i, x in got] == [(i, len(x)) for i, x in want]
    assert all(abs(weight(a) - weight(b)) < 1e-6 for (_, a), (_, b) in zip(got, want))
    assert sum(a == b for (_, a), (_, b) in zip(got, want)) > 0.9 * len(want)
    measured = sorted((r.doc_id if r.doc_id is not None else -1, r.n_pieces, r.ids_sum, r.decoded_chars, r.decodes) for r in sentencepiece.digest(every, "piece_bpe_32k.model").collect())
    text_of = sorted((i, len(x), sum(x), len(t or ""), True) for (i, t), x in zip([((i if i is not None else -1), t) for i, t in [*enumerate(texts()), *more]], [segment(t, pieces, score, ids) if t else [] for t in [*texts(), *(t for _, t in more)]]))
    assert [(a[0], a[1], a[3], a[4]) for a in measured] == [(a[0], a[1], a[3], a[4]) for a in text_of]


def test_ids_decode_to_the_text(spark, docs, pieces):  # noqa: F811
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(docs, pieces), pieces).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}


def test_no_piece_crosses_a_cut(spark, pieces):
    assert sentencepiece.joined_to_letters(["a'b", "'-", "12", "x"]) == {"'", "-"}
    kind = lambda c: "letter" if unicodedata.category(c)[0] in "LM" or c in pieces.letters else "other"
    assert all(len({kind(c) for c in p.lstrip("▁")}) <= 1 for p, _, _ in pieces.rows)
    cut = spark.createDataFrame([("it's 12 ab,\nc  d$$",)], "t string").select(sentencepiece.words(sentencepiece.F.col("t"), pieces).alias("w")).first().w
    assert cut == ["▁it", "'", "s", "▁12", "▁ab", ",", "\n", "c", "▁▁d", "$$"]


def test_empty_tables(spark, pieces):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece.digest(none, "piece_bpe_32k.model").count() == sentencepiece.encode(none, pieces).count() == 0


def test_the_dictionary_keeps_to_its_bounds(spark, pieces):
    known = spark.createDataFrame([(f"w{i}", i + 1, [1, 2]) for i in range(300)], "word string, n long, ids array<int>")
    for size, room in ((100, 1 << 20), (1000, 500), (0, 10), (1000, 1 << 20)):
        n = sentencepiece.frequent_from(known, size, room)
        chosen = known.where(f"n >= {n}").collect()
        assert len(chosen) <= size and sum(len(r.word) + 8 for r in chosen) <= room
    assert n == 1


def test_the_digest_is_of_whole_encoded_and_decoded_texts(spark, docs, pieces):  # noqa: F811
    F = sentencepiece.F
    encoded = sentencepiece.encode(docs, pieces).select("doc_id", "ids", F.xxhash64("ids").alias("ids_print"))
    want = {r.doc_id: (r.ids_print, len(r.ids), sum(r.ids)) for r in encoded.collect()}
    got = sentencepiece.digest(docs, "piece_bpe_32k.model").collect()
    assert {r.doc_id: (r.ids_print, r.n_pieces, r.ids_sum) for r in got} == want and all(r.decodes for r in got)
    assert {r.doc_id: r.decoded_chars for r in got} == {i: len(t or "") for i, t in enumerate(texts())}
