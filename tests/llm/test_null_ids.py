from keyloom.llm import near_dedup


def test_rows_without_an_id_stay_unlinked(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (None, text), (None, "alone"), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in near_dedup.cluster(df).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 56, 1, True), (2, 56, 1, False)]
    assert sorted(x[1:] for x in got if x[0] is None) == [(0, None, True), (1, None, True), (56, None, True)]
    assert sorted(map(str, (tuple(r) for r in near_dedup.keep_one(df).collect()))) == sorted(map(str, [(1, text), (None, text), (None, "alone"), (None, None)]))
