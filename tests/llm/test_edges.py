import random

from test_operators import SCHEMA

from keyloom.llm import packing, pfor, quality_rules, suffix_dedup, topk


def test_tokens_of_rows_without_a_key_and_of_equal_keys(spark):
    rows = [(None, "b"), (-1, "a"), (-1, "a"), (None, None), (5, "")]
    got = [tuple(r) for r in pfor.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(r[0] for r in got if r[0] is not None) == [-1, -1, 5] and len(got) == 5
    at = 0
    for key, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [None, None, -1, -1, 5]


def test_characters_cut_in_two_go_and_others_stay(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    one = "é" + passage + "é� tail one"
    two = "�xè" + passage + "è other �"  # è and é share their first byte
    rows = [(1, one, "en", "s", len(one), None), (2, two, "en", "s", len(two), None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.clean_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (one, len(one))
    assert got[2] == ("�xè other �", 11)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.assess(none).count() == pfor.round_trip(none).count() == packing.pack(none).count() == 0


def test_empty_vectors_take_part(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, []), (2, [-1.0, 0.0]), (3, None), (4, [None])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id = 0"), 5).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, -65536)]
