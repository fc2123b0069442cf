import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.operators import collections, jsondocs, stats, strings, writes, zsets
from keyloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = ["set_conditions", "set_keepttl", "vec_set", "vec_refused", "vec_ttl", "migrate_slots", "registry", "session_windows", "sliding_windows", "json_get_kinds", "json_type_kinds", "zrevrangebylex_limit"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = sorted(str([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == rows and rows


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_scores_as_text(spark):
    want = {0.0: "0", -3.0: "-3", 1.5: "1.5", 1e20: "1" + "0" * 20, -1.25e18: "-125" + "0" * 16, 1e-5: "0.00001", -1.5e-7: "-0.00000015", 12345678.5: "12345678.5", 123456789.25: "123456789.25", float("inf"): "inf", float("-inf"): "-inf"}
    df = spark.createDataFrame([(x,) for x in want], "s double")
    assert {r.s: r.t for r in df.select("s", zsets.format_score(F.col("s")).alias("t")).collect()} == want


def test_float_arguments(spark):
    good = {"1.5": 1.5, "+2": 2.0, "-.5": -0.5, "1.": 1.0, "1e3": 1000.0, "Inf": float("inf"), "-infinity": float("-inf")}
    bad = ["1.5d", "1f", " 1.5 ", "0x1p3", "nan", "", ".", "e5", "1e", "--1"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string")
    got = {r.t: r.n for r in df.select("t", strings.parse_float(F.col("t")).alias("n")).collect()}
    assert got == good | dict.fromkeys(bad)


def test_json_values_of_every_kind(spark):
    doc = '{"s":"a\\"b","n":null,"i":3,"f":1.5,"t":true,"l":[1,"x",{"z":1,"a":[]}],"o":{"k":"v"}}'
    want = {"$.s": '["a\\"b"]', "$.n": "[null]", "$.i": "[3]", "$.f": "[1.5]", "$.t": "[true]", "$.l[-1]": '[{"z":1,"a":[]}]', "$.l[-2]": '["x"]', "$.l[-4]": "[]", "$.l[1]": '["x"]', "$.missing": "[]", "$.s[-1]": "[]", "s": '"a\\"b"', "missing": None, "l[-3]": "1"}
    assert {p: one(spark, jsondocs.get(F.lit(doc), p)) for p in want} == want


def test_conditional_writes(spark):
    rows = [(1, 1, "XX", "a"), (1, 2, "NX", "b"), (1, 3, "NX", "c"), (1, 4, "XX", "d"), (2, 1, "SET", "a"), (2, 2, "DEL", None), (2, 3, "XX", "b"), (3, 1, "SET", "a"), (3, 2, "DEL", None), (3, 3, "NX", "z"), (4, 1, "XX", "a")]
    got = {r.key: r.value for r in writes.conditional(spark.createDataFrame(rows, "key int, seq int, op string, value string")).collect()}
    assert got == {1: "d", 3: "z"}


def test_migration_again_changes_nothing_and_old_epochs_are_refused(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 9), ("b", "x", 1)], "holder string, key string, slot int")
    once = writes.migrate(rows, F.col("slot"), F.col("slot") < 5, "a", "b")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, writes.migrate(once, F.col("slot"), F.col("slot") < 5, "a", "b").collect())) == [("a", "y", 9), ("b", "x", 1)]
    log = spark.createDataFrame([("t", 1, 5), ("t", 2, 4), ("t", 3, 5), ("u", 1, 1)], "ns string, seq int, epoch int")
    assert {(r.ns, r.seq): r.accepted for r in writes.fenced(log, "ns").collect()} == {("t", 1): True, ("t", 2): False, ("t", 3): True, ("u", 1): True}


def test_buckets_are_by_namespace(spark):
    rows = [("n", 1, 1, 0), ("n", 2, 2, 0), ("n", 3, 3, 0), ("n", 1, 4, 500), ("n", 2, 5, 500), ("o", 1, 6, 0)]
    got = {r.seq: r.admitted for r in stats.token_bucket(spark.createDataFrame(rows, "ns string, key long, seq long, ts_ms long"), 2.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_vectors_are_refused_by_dimension_and_expire(spark):
    made = collections.create(spark.createDataFrame([(1, "s", 2, "l2"), (2, "s", 3, "ip"), (3, "t", 0, "l2"), (4, "u", 2, "other")], "seq long, set string, dim int, metric string"))
    assert [tuple(r) for r in made.collect()] == [("s", 2, "l2")]
    log = [(1, "s", 7, [1.0, 2.0], 50), (2, "s", 7, [3.0], 0), (3, "s", 8, [5.0, 5.0], 40), (4, "s", 8, [6.0, 6.0], 0), (5, "t", 1, [1.0], 0)]
    held, refused = collections.upsert(spark.createDataFrame(log, "seq long, set string, id long, embedding array<double>, expire_ms long"), made)
    assert sorted((r.seq, r.reason) for r in refused.collect()) == [(2, "WRONGDIM"), (5, "NOSET")]
    assert {r.id: r.ttl for r in collections.left_ms(held, 50).collect()} == {7: -2, 8: -1}
    assert [r.id for r in collections.swept(held, 50).collect()] == [8]
