from pyspark.sql import functions as F

from keyloom.operators import bloom
from keyloom.plans import catalog


def test_a_filter_grows_by_links(spark):
    item = F.encode(F.concat(F.lit("i"), F.col("id").cast("string")), "utf-8").alias("item")
    inside, outside = spark.range(3000).select(item, F.col("id").alias("at")), spark.range(100_000, 110_000).select(item)
    ranks = sorted(r["rank"] for r in bloom.arrived(inside.unionByName(inside)).collect())
    assert ranks == list(range(3000))
    filters = bloom.chain(inside, 100, 0.01)
    assert [p for _, p in filters] == bloom.links(100, 0.01, 3000) and len(filters) == 5
    assert bloom.any_holds(inside.select("item"), filters).where("not found").count() == 0
    assert bloom.any_holds(outside, filters).where("found").count() < 500


def test_bloom_exists_is_not_overfull(spark, tmp_path):
    spark.range(600_000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["half"], r["found"]): r["n"] for r in catalog.QUERIES["bloom_exists"](spark, str(tmp_path)).collect()}
    assert got[0, True] == 300_000 and (0, False) not in got
    assert got.get((1, True), 0) < 1500
