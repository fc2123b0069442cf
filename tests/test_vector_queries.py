import numpy as np

from keyloom.operators import vectors
from keyloom.plans import catalog


def rows(n):
    return [(i, [float(i % 7), float(i % 11), float(i)], 0) for i in range(n)]


def test_search_goes_on_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame(rows(40), "id long, embedding array<float>, label int")
    want = sorted(tuple(r) for r in vectors.search(v, v, 3, "l2").collect())
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 15)
    assert sorted(tuple(r) for r in vectors.search(v, v, 3, "l2").collect()) == want and len(want) == 120


def test_approximate_asks_every_fiftieth_row(spark, tmp_path):
    spark.createDataFrame(rows(201), "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["vec_search_approximate"](spark, str(tmp_path)).collect()
    assert {r["query"] for r in got} == {0, 50, 100, 150, 200}


def test_approximate_moves_no_vectors(spark, monkeypatch):
    """The k nearest of each task are all that is exchanged; recall is held against brute force."""
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 15)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    odd = [(900, None), (901, [float("nan")] * 16), (902, [1.0, None]), (903, []), (3, [float(v) for v in x[3]])]
    v = spark.createDataFrame([*((i, [float(c) for c in row]) for i, row in enumerate(x)), *odd], "id long, embedding array<double>").repartition(3)
    out = vectors.approximate(v, v.where("id % 20 = 0"), 5, 1.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = out.collect()
    want = {(q, int(i)) for q in range(0, 900, 20) for i in np.lexsort((np.arange(900), ((x - x[q]) ** 2).sum(1)))[:5]}
    assert len(got) == len(want) == 225 and len({(r["query"], r["id"]) for r in got} & want) >= 0.9 * len(want)
    assert all(abs(r["score"] + ((x[r["query"]] - x[r["id"]]) ** 2).sum()) < 1e-9 for r in got)
    few = vectors.approximate(v, v.where("id % 20 = 0"), 5, 0.05, tables=1).collect()
    assert 0 < len(few) <= 225 and {r["query"] for r in few if r["id"] == r["query"]} == set(range(0, 900, 20))
