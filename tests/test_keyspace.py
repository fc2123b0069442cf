import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import glob, murmur, slots
from keyloom.operators import balance, bloom, jsondocs, keyspace, lists, sets, stats, strings, vectors, zsets
from keyloom.sources import files, wire
from keyloom.streaming import folds, replay


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_weighted_union_and_intersection(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "member string, score double")
    b = spark.createDataFrame([("b", 10.0), ("c", 20.0)], "member string, score double")
    assert rows(zsets.combine([a, b], [1, 1])) == [("a", 1.0), ("b", 12.0), ("c", 20.0)]
    assert rows(zsets.combine([a, b], [2, 3])) == [("a", 2.0), ("b", 34.0), ("c", 60.0)]
    assert rows(zsets.combine([a, b], [1, 1], every=True)) == [("b", 12.0)]


def test_nan_is_zero_after_weighting_and_combining(spark):
    a = spark.createDataFrame([("m", math.inf), ("n", math.inf)], "member string, score double")
    b = spark.createDataFrame([("m", -math.inf)], "member string, score double")
    assert rows(zsets.combine([a, b], [1, 1])) == [("m", 0.0), ("n", math.inf)]
    assert rows(zsets.combine([a], [0])) == [("m", 0.0), ("n", 0.0)]


def test_lex_walk_takes_the_first_run_only(spark):
    z = spark.createDataFrame([("k", "b", 1.0), ("k", "z", 2.0), ("k", "c", 3.0)], "key string, member string, score double")
    assert rows(zsets.lex_walk(z, "a", "d"), "member") == [("b",)]
    even = z.withColumn("score", F.lit(0.0))
    assert rows(zsets.lex_walk(even, "b", "d", open_low=True), "member") == [("c",)]
    assert rows(zsets.lex_walk(even, "d", "a"), "member") == []


def test_positions_in_a_list(spark):
    values = list("abcabca")
    one = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, idx long, value string")
    at = lambda **x: [r[1] for r in rows(lists.positions(one, F.col("value") == "a", **x), "nth", "idx")]
    assert at(rank=2) == [3]
    assert at(rank=-1) == [6]
    assert at(count=0) == [0, 3, 6]
    assert at(rank=-1, count=2) == [6, 3]
    assert at(count=0, max_compared=2) == [0]
    with pytest.raises(ValueError):
        at(rank=0)


def test_expiry_includes_the_instant_and_rounding(spark):
    k = spark.createDataFrame([("0", "a", 1000), ("0", "b", 1001), ("0", "c", 0), ("0", "d", 2999)], "ns string, key string, expire_ms long")
    from keyloom.model import live

    assert rows(k.where(live(1000)), "key") == [("b",), ("c",), ("d",)]
    left = k.select("key", keyspace.remaining(1000, 1000).alias("ttl"), keyspace.instant(1000).alias("at"))
    assert rows(left.where("key > 'a'")) == [("b", 1, 1), ("c", -1, -1), ("d", 2, 2)]


def test_exists_counts_repeats_and_delete_does_not(spark):
    k = spark.createDataFrame([("0", "a", 0)], "ns string, key string, expire_ms long")
    probes = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert keyspace.exists(k, probes, 1).first()[0] == 2
    assert keyspace.delete(k, probes, 1)[1].first()[0] == 1


def test_set_algebra(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "key string, member int")
    assert rows(sets.inter(s, ["a", "b", "a"])) == [(2,)]
    assert rows(sets.inter(s, ["a", "none"])) == []
    assert rows(sets.diff(s, "a", ["b"])) == [(1,)]
    assert rows(sets.store(s, "a", sets.inter(s, ["a", "b"]))) == [("a", 2), ("b", 2), ("b", 3)]


def test_slots_of_known_keys(spark):
    known = {"foo": 12182, "bar": 5061, "123456789": 12739}
    df = spark.createDataFrame([(k,) for k in [*known, "{u}.x", "{u}.y", "{}a"]], "key string")
    got = {r[0]: r[1] for r in df.select("key", slots.slot(F.col("key"))).collect()}
    assert {k: got[k] for k in known} == known
    assert got["{u}.x"] == got["{u}.y"]


def test_murmur_of_known_inputs(spark):
    h1, h2 = murmur.hash_many([b"a", b"abcdefgh", b"abcdefghi", b""])
    assert [f"{int(x):016X}" for x in h1] == ["85555565F6597889", "CC8A0AB037EF8C02", "0547C0CFF13C7964", "0" * 16]
    assert [f"{int(x):016X}" for x in h2] == ["E6B53A48510E895A", "48890D60EB6940A1", "79B53DF5B741E033", "0" * 16]


def test_bloom_sizes_and_error_rate(spark):
    assert bloom.plan(1_000_000, 0.01).hashes == 7 and bloom.plan(100, 0.01) == bloom.Plan(7, 10, 1)
    for bad in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            bloom.plan(*bad)
    p = bloom.plan(10_000, 0.01)
    inside = spark.range(9000).select(F.encode(F.concat(F.lit("in"), "id"), "utf-8").alias("item"))
    outside = spark.range(20_000).select(F.encode(F.concat(F.lit("out"), "id"), "utf-8").alias("item"))
    blocks = bloom.build(inside, p).cache()
    assert bloom.might_hold(inside, blocks, p).where("not found").count() == 0
    assert 0.0005 < bloom.might_hold(outside, blocks, p).where("found").count() / 20_000 < 0.025


def test_globs(spark):
    cases = [("h?llo", "hello", True), ("h*o", "ho", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("[c-a]x", "bx", True), ("[abc", "a", False), ("a\\*", "a*", True), ("a\\*", "ab", False), ("*", "", True)]
    for pattern, subject, want in cases:
        assert spark.range(1).select(glob.matches(F.lit(subject), pattern)).first()[0] is want, pattern


def test_json_paths_and_changes():
    assert jsondocs.parse_path("$.a[0]['b']") == (["a", 0, "b"], True)
    with pytest.raises(ValueError):
        jsondocs.parse_path("$..a")
    assert jsondocs.set_value('{"b":1,"a":[1]}', ["a", 1], "2") == '{"b":1,"a":[1,2]}'
    with pytest.raises(ValueError):
        jsondocs.set_value('{"a":[1]}', ["a", 5], "2")
    with pytest.raises(ValueError):
        jsondocs.set_value("{}", ["x", "y"], "2")
    assert jsondocs.add_number('{"a":1}', ["a"], 2) == '{"a":3}'
    assert jsondocs.add_number('{"a":1}', ["a"], 0.5) == '{"a":1.5}'
    assert jsondocs.delete('{"a":1}', []) is None


def test_byte_ranges(spark):
    df = spark.createDataFrame([(b"hello",)], "b binary")
    got = df.select(*[strings.get_range(F.col("b"), *x) for x in ((0, 1), (-3, -1), (3, 1), (0, 99))], strings.set_range(F.col("b"), 7, b"x")).first()
    assert [bytes(x) for x in got] == [b"he", b"llo", b"", b"hello", b"hello\0\0x"]


def test_moves(spark):
    assert balance.plan_moves({"a": 1600, "b": 1000, "c": 400}, 0.2) == [("a", "c", 600)]
    assert balance.plan_moves({"a": 1150, "b": 1000, "c": 850}, 0.2) == []


def test_nearest_vectors(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [3.0, 4.0])], "id string, embedding array<float>")
    got = vectors.search(v, v.where("id = 'a'"), 3, "l2").orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 0.0), ("b", -1.0), ("c", -25.0)]


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    q = v.where("id < 10")
    exact = {(r.query, r.id) for r in vectors.search(v, q, 5, "l2").collect()}
    found = {(r.query, r.id) for r in vectors.approximate(v, q, 5, 4.0).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_wire_format():
    value = [b"SET", b"k", 5, None, [b"x"]]
    for version in (2, 3):
        assert wire.decode(wire.encode(value, version))[0] == value
    with pytest.raises(wire.Incomplete):
        wire.decode(b"$5\r\nab")
    assert wire.decode(b"PING a\r\n")[0] == [b"PING", b"a"]


def test_counters_with_resets(spark):
    log = spark.createDataFrame([("k", 1, "incr", 5), ("k", 2, "set", 1), ("k", 3, "incr", 2), ("g", 1, "set", 3), ("g", 2, "del", 0)], "key string, seq long, op string, value long")
    assert rows(folds.counters(log)) == [("k", 3)]


def test_transactions_and_watches(spark):
    log = spark.createDataFrame([(1, False), (1, True), (2, False)], "txn long, bad boolean")
    assert rows(stats.committed(log, F.col("bad")), "txn") == [(2,)]
    w = spark.createDataFrame([(1, "k", 5, 9), (2, "k", 9, 12)], "txn long, key string, begin long, end long")
    assert rows(stats.watch_conflicts(w, spark.createDataFrame([("k", 7)], "key string, seq long"))) == [(1, True), (2, False)]


def test_backup_verification_and_journal(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set/a.bin").write_bytes(b"one")
    (tmp_path / "set/b.bin").write_bytes(b"two")
    manifest = spark.createDataFrame(files.manifest_of(spark, f"file://{tmp_path}/set").collect())
    assert files.verify(manifest, files.manifest_of(spark, f"file://{tmp_path}/set")).count() == 0
    (tmp_path / "set/a.bin").write_bytes(b"x")
    (tmp_path / "set/b.bin").unlink()
    (tmp_path / "set/c.bin").write_bytes(b"new")
    assert rows(files.verify(manifest, files.manifest_of(spark, f"file://{tmp_path}/set"))) == [("a.bin", "checksum"), ("b.bin", "missing"), ("c.bin", "unlisted")]
    (tmp_path / "j.json").write_text("".join(json.dumps({"at_ms": i, "kind": "x" if i % 2 else "y"}) + "\n" for i in range(6)))
    assert [r.at_ms for r in files.journal_tail(files.journal(spark, f"file://{tmp_path}/j.json"), 2, ["x"]).collect()] == [3, 5]
    ident = files.snapshot(spark.range(3), f"file://{tmp_path}/snap")
    assert ident and files.latest(spark, f"file://{tmp_path}/snap").count() == 3


def test_streamed_log_gives_the_same_rows_twice(spark, tmp_path):
    log = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 5).alias("key"), F.lit(1).cast("long").alias("value"), (F.col("id") * 100).alias("ts_ms"))
    log.repartition(4).write.parquet(f"{tmp_path}/log")
    for _ in range(2):
        replay.apply(replay.log_stream(spark, f"{tmp_path}/log", "seq long, key long, value long, ts_ms long", 2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    assert tuple(replay.cursor(spark, f"{tmp_path}/out").first()) == (99, False)
