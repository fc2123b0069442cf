import re

from keyloom.llm import pfor, store


def test_payloads_are_read_in_place(spark, tmp_path, monkeypatch):
    """Reading deals out only the starts of segments, however large Spark takes them to be; payloads are not shuffled."""
    monkeypatch.setattr(pfor, "SEGMENT_IDS", 8)
    docs = spark.createDataFrame([(d, f"text {d} of some words") for d in range(40)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    pfor.write_tokens(docs, path)
    with store.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        read = pfor.read_tokens(spark, path)
        rows = sorted(tuple(r) for r in read.collect())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"Exchange hashpartitioning\(shard#\w+, segment#", plan)
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + r[2])
    assert [r[0] for r in rows] == list(range(40)) and [r[1] for r in rows] == ends[:-1]
