"""Every query of the keyspace operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import model as m
from keyloom.functions import glob, slots
from keyloom.operators import balance, bloom, hashes, jsondocs, keyspace, lists, sets, stats, strings, vectors, zsets
from keyloom.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["zrevrange"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- sorted sets -------------------------------------------------------------------------

Z = "(SELECT o_custkey AS key, o_orderkey AS member, o_totalprice AS score FROM orders)"
ZR = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM {Z})"
ZV = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM {Z})"


@query(f"SELECT key, member, score, rank FROM {ZV} WHERE rank <= 2")
def zrevrange(spark, sf):
    return zsets.by_rank(m.zset_members(spark, sf), 0, 2, reverse=True)


@query(f"SELECT key, member, score, rank FROM {ZR} WHERE rank BETWEEN 1 AND 3")
def zrange(spark, sf):
    return zsets.by_rank(m.zset_members(spark, sf), 1, 3)


@query(f"SELECT key, member, score, rank FROM {ZR} WHERE rank BETWEEN n - 2 AND n - 1")
def zrange_negative(spark, sf):
    return zsets.by_rank(m.zset_members(spark, sf), -2, -1)


@query(f"""SELECT key, member, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank
FROM {Z} WHERE score > 50000 AND score <= 200000) WHERE rank BETWEEN 1 AND 2""")
def zrangebyscore_limit(spark, sf):
    return zsets.by_score(m.zset_members(spark, sf), 50000, 200000, open_low=True, offset=1, limit=2)


@query(f"""SELECT key, member, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank
FROM {Z} WHERE score >= 50000 AND score < 200000) WHERE rank < 2""")
def zrevrangebyscore(spark, sf):
    return zsets.by_score(m.zset_members(spark, sf), 50000, 200000, open_high=True, offset=-3, limit=2, reverse=True)


@query(f"SELECT key, member, rank FROM {ZR}")
def zrank(spark, sf):
    return zsets.ranked(m.zset_members(spark, sf)).select("key", "member", "rank")


@query(f"SELECT key, member, rank FROM {ZV}")
def zrevrank(spark, sf):
    return zsets.ranked(m.zset_members(spark, sf), reverse=True).select("key", "member", "rank")


@query(f"SELECT key, count(*) FILTER (score BETWEEN 50000 AND 150000) AS n FROM {Z} GROUP BY key")
def zcount(spark, sf):
    return m.zset_members(spark, sf).groupBy("key").agg(F.count_if(zsets.score_between(50000, 150000)).alias("n"))


@query(f"SELECT key, count(*) AS n FROM {Z} GROUP BY key")
def zcard(spark, sf):
    return m.zset_members(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@query(f"SELECT key, member, score FROM {ZR} WHERE rank < 2")
def zpopmin(spark, sf):
    return zsets.by_rank(m.zset_members(spark, sf), 0, 1).select("key", "member", "score")


@query(f"SELECT key, member, score FROM {ZV} WHERE rank < 2")
def zpopmax(spark, sf):
    return zsets.by_rank(m.zset_members(spark, sf), 0, 1, reverse=True).select("key", "member", "score")


@query(f"SELECT key, member, score FROM {Z} WHERE NOT (score >= 50000 AND score <= 150000)")
def zremrangebyscore(spark, sf):
    return m.zset_members(spark, sf).where(~zsets.score_between(50000, 150000))


@query(f"SELECT key, member, score FROM {ZR} WHERE rank > 1")
def zremrangebyrank(spark, sf):
    return zsets.ranked(m.zset_members(spark, sf)).where("rank > 1").select("key", "member", "score")


@query(f"SELECT p.key, p.member, z.score FROM (SELECT o_custkey AS key, o_orderkey + (o_orderkey % 2) * 1000000000 AS member FROM orders) p LEFT JOIN {Z} z ON p.key = z.key AND p.member = z.member")
def zscore(spark, sf):
    z = m.zset_members(spark, sf)
    probes = z.select("key", (F.col("member") + F.col("member") % 2 * 1000000000).alias("member"))
    return probes.join(z, ["key", "member"], "left")


@query(f"SELECT key, member, score FROM {Z} WHERE member % 3 <> 0")
def zrem(spark, sf):
    z = m.zset_members(spark, sf)
    return z.join(z.where("member % 3 = 0").select("key", "member"), ["key", "member"], "left_anti")


def _zlog(spark, sf):
    e = m.op_log(spark, sf)
    return e.select(F.col("op").alias("key"), F.col("key").alias("member"), F.col("value").alias("score"), "ts_ms", "seq")


@query("SELECT event_type AS key, user_id AS member, arg_max(value, (ts, event_id)) AS score FROM events GROUP BY ALL")
def zadd(spark, sf):
    return zsets.upsert(_zlog(spark, sf), "ts_ms", "seq")


@query("SELECT event_type AS key, user_id AS member, round(sum(value), 4) AS score FROM events GROUP BY ALL")
def zincrby(spark, sf):
    return _zlog(spark, sf).groupBy("key", "member").agg(F.round(F.sum("score"), 4).alias("score"))


def _per_user(spark, sf, kind):
    return m.table(spark, sf, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("member")).agg(F.sum("value").alias("score"))


_IN = "(SELECT user_id AS member, sum(value) AS score FROM events WHERE event_type = '{}' GROUP BY 1)"
_TWO = f"(SELECT member, 2 * score AS score FROM {_IN.format('click')} UNION ALL SELECT member, 3 * score FROM {_IN.format('view')})"


@query(f"SELECT member, round(sum(score), 4) AS score FROM {_TWO} GROUP BY member")
def zunionstore_sum(spark, sf):
    out = zsets.combine([_per_user(spark, sf, "click"), _per_user(spark, sf, "view")], [2, 3])
    return out.withColumn("score", F.round("score", 4))


@query(f"SELECT member, round(max(score), 4) AS score FROM {_TWO} GROUP BY member")
def zunionstore_max(spark, sf):
    return zsets.combine([_per_user(spark, sf, "click"), _per_user(spark, sf, "view")], [2, 3], "max").withColumn("score", F.round("score", 4))


@query(f"SELECT member, round(min(score), 4) AS score FROM {_TWO} GROUP BY member HAVING count(*) = 2")
def zinterstore_min(spark, sf):
    return zsets.combine([_per_user(spark, sf, "click"), _per_user(spark, sf, "view")], [2, 3], "min", every=True).withColumn("score", F.round("score", 4))


_LEX = "(SELECT p_brand AS key, p_name || '#' || p_partkey AS member, {} AS score FROM part)"
_WALK = """WITH f AS (SELECT *, member >= 'b' AND member < 'p' AS inside FROM {0}),
g AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY key ORDER BY score, member)),
h AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY score, member) AS island FROM g)
SELECT {1} FROM h WHERE inside AND island = 1"""


def _lex(spark, sf, score):
    return m.table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("member"), score.cast("double").alias("score"))


@query(_WALK.format(_LEX.format("0"), "key, member"))
def zrangebylex(spark, sf):
    return zsets.lex_walk(_lex(spark, sf, F.lit(0)), "b", "p", open_high=True).select("key", "member")


@query(_WALK.format(_LEX.format("p_size"), "key, member"))
def zrangebylex_mixed(spark, sf):
    return zsets.lex_walk(_lex(spark, sf, F.col("p_size")), "b", "p", open_high=True).select("key", "member")


@query(_WALK.format(_LEX.format("0"), "key, count(*) AS n") + " GROUP BY key")
def zlexcount(spark, sf):
    return zsets.lex_walk(_lex(spark, sf, F.lit(0)), "b", "p", open_high=True).groupBy("key").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM {_LEX.format('0::DOUBLE')} WHERE NOT (member >= 'b' AND member < 'p')")
def zremrangebylex(spark, sf):
    z = _lex(spark, sf, F.lit(0))
    return z.join(zsets.lex_walk(z, "b", "p", open_high=True).select("key", "member"), ["key", "member"], "left_anti")


@query("SELECT l_orderkey AS key, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS text FROM lineitem GROUP BY 1")
def score_text(spark, sf):
    s = m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_quantity").alias("s"))
    return s.select("key", zsets.format_score(F.col("s")).alias("text"))


# --- sets --------------------------------------------------------------------------------

S = "(SELECT DISTINCT event_type AS key, user_id AS member FROM events)"
SV = "(SELECT DISTINCT event_type AS key, user_id AS member FROM events WHERE value > 120)"


@query(f"SELECT key, count(*) AS n FROM {S} GROUP BY key")
def scard(spark, sf):
    return m.set_members(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@query(f"SELECT key, member FROM {S}")
def smembers(spark, sf):
    return m.set_members(spark, sf)


@query("SELECT DISTINCT event_type AS key, user_id AS member FROM events UNION SELECT 'added', c_custkey FROM customer WHERE c_custkey < 50")
def sadd(spark, sf):
    new = m.table(spark, sf, "customer").where("c_custkey < 50").select(F.lit("added").alias("key"), F.col("c_custkey").alias("member"))
    return sets.add(m.set_members(spark, sf), new)


@query(f"SELECT key, member FROM {S} WHERE member % 5 <> 0")
def srem(spark, sf):
    s = m.set_members(spark, sf)
    return sets.remove(s, s.where("member % 5 = 0"))


@query(f"SELECT member FROM {SV} WHERE key = 'purchase' INTERSECT SELECT member FROM {SV} WHERE key = 'click'")
def sinter(spark, sf):
    return sets.inter(m.set_members(spark, sf, 120), ["purchase", "click", "purchase"])


@query(f"SELECT DISTINCT member FROM {SV} WHERE key IN ('purchase', 'click')")
def sunion(spark, sf):
    return sets.union(m.set_members(spark, sf, 120), ["purchase", "click"])


@query(f"SELECT member FROM {SV} WHERE key = 'click' EXCEPT SELECT member FROM {SV} WHERE key IN ('purchase', 'error')")
def sdiff(spark, sf):
    return sets.diff(m.set_members(spark, sf, 120), "click", ["purchase", "error"])


@query(f"SELECT key, member FROM {SV} WHERE key <> 'view' UNION ALL SELECT 'view', member FROM (SELECT member FROM {SV} WHERE key = 'view' INTERSECT SELECT member FROM {SV} WHERE key = 'click')")
def sinterstore(spark, sf):
    s = m.set_members(spark, sf, 120)
    return sets.store(s, "view", sets.inter(s, ["view", "click"]))


@query(f"""SELECT p.pos, p.key, p.member, CASE WHEN s.member IS NULL THEN 0 ELSE 1 END AS found
FROM (SELECT event_id AS pos, CASE event_type WHEN 'click' THEN 'view' ELSE 'click' END AS key, user_id AS member FROM events) p LEFT JOIN {SV} s ON p.key = s.key AND p.member = s.member""")
def smismember(spark, sf):
    e = m.table(spark, sf, "events")
    probes = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "click", "view").otherwise("click").alias("key"), F.col("user_id").alias("member"))
    return sets.is_member(m.set_members(spark, sf, 120), probes)


@query(f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('s' || member), member) AS r FROM {S}) WHERE r <= 7")
def srandmember(spark, sf):
    return sets.sample(m.set_members(spark, sf), 7, "s")


@query(f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('s' || member), member) AS r FROM {S}) WHERE r > 7")
def spop(spark, sf):
    s = m.set_members(spark, sf)
    return sets.remove(s, sets.sample(s, 7, "s"))


@query(f"SELECT key, pick FROM (SELECT DISTINCT key FROM {S}), (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS pick)")
def srandmember_repeats(spark, sf):
    return sets.sample_with_repeats(m.set_members(spark, sf), 12, 5).select("key", "pick")


# --- hashes ------------------------------------------------------------------------------

H = """(SELECT c_custkey AS key, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)"""
_HW = "event_type AS key, CAST(user_id % 10 AS VARCHAR) AS field"


def _hlog(spark, sf):
    e = m.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("key"), (F.col("user_id") % 10).cast("string").alias("field"), F.round("value", 4).alias("value"), F.struct("ts", "event_id").alias("seq"))


@query(f"SELECT {_HW}, round(arg_max(value, (ts, event_id)), 4) AS value FROM events GROUP BY ALL")
def hset(spark, sf):
    return hashes.put(_hlog(spark, sf))


@query(f"SELECT {_HW}, round(arg_min(value, (ts, event_id)), 4) AS value FROM events GROUP BY ALL")
def hsetnx(spark, sf):
    return hashes.put(_hlog(spark, sf), first=True)


@query(f"SELECT key, field, value FROM {H}")
def hgetall(spark, sf):
    return m.hash_fields(spark, sf)


@query(f"SELECT key, list(field ORDER BY field) AS fields FROM {H} GROUP BY key")
def hkeys(spark, sf):
    return hashes.as_map(m.hash_fields(spark, sf)).select("key", F.map_keys("fields").alias("fields"))


@query(f"SELECT key, list(value ORDER BY field) AS vals FROM {H} GROUP BY key")
def hvals(spark, sf):
    return hashes.as_map(m.hash_fields(spark, sf)).select("key", F.map_values("fields").alias("vals"))


@query(f"SELECT p.key, p.pos, p.field, h.value FROM (SELECT c_custkey AS key, unnest([0, 1]) AS pos, unnest(['segment', 'absent']) AS field FROM customer) p LEFT JOIN {H} h ON p.key = h.key AND p.field = h.field")
def hmget(spark, sf):
    probes = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.posexplode(F.array(F.lit("segment"), F.lit("absent"))).alias("pos", "field"))
    return hashes.get_many(m.hash_fields(spark, sf), probes)


@query(f"SELECT key, field, value FROM {H} WHERE NOT (field = 'nation' AND key % 2 = 0)")
def hdel(spark, sf):
    h = m.hash_fields(spark, sf)
    return hashes.drop(h, h.where("field = 'nation' and key % 2 = 0").select("key", "field"))


@query(f"SELECT key, count(*) AS n FROM {H} GROUP BY key")
def hlen(spark, sf):
    return hashes.sizes(m.hash_fields(spark, sf))


@query(f"SELECT key, field, strlen(value) AS n FROM {H}")
def hstrlen(spark, sf):
    return m.hash_fields(spark, sf).select("key", "field", F.octet_length("value").cast("long").alias("n"))


@query("SELECT l_suppkey AS key, l_returnflag AS field, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY ALL")
def hincrby(spark, sf):
    return hashes.increment(m.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("delta")))


# --- lists -------------------------------------------------------------------------------

L = "(SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_partkey AS value, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@query(f"SELECT key, count(*) AS n FROM {L} GROUP BY key")
def llen(spark, sf):
    return lists.sizes(m.list_elems(spark, sf))


@query(f"SELECT key, idx, value FROM {L} WHERE idx = n - 1")
def lindex(spark, sf):
    return lists.index(m.list_elems(spark, sf), -1)


@query(f"SELECT key, idx, value FROM {L} WHERE idx BETWEEN 1 AND n - 2")
def lrange(spark, sf):
    return lists.between(m.list_elems(spark, sf), 1, -2)


@query(f"SELECT key, idx - 1 AS idx, value FROM {L} WHERE idx BETWEEN 1 AND 3")
def ltrim(spark, sf):
    return lists.trim(m.list_elems(spark, sf), 1, 3)


@query(f"SELECT key, idx, value FROM {L} WHERE idx = 0")
def lpop(spark, sf):
    return lists.pop(m.list_elems(spark, sf))


@query(f"SELECT key, idx, value FROM {L} WHERE idx = n - 1")
def rpop(spark, sf):
    return lists.pop(m.list_elems(spark, sf), right=True)


@query("SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS idx, event_type AS value FROM events")
def lpush(spark, sf):
    return lists.push(m.op_log(spark, sf).select("key", "seq", F.col("op").alias("value")), left=True)


@query("SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_type AS value FROM events")
def rpush(spark, sf):
    return lists.push(m.op_log(spark, sf).select("key", "seq", F.col("op").alias("value")), left=False)


@query(f"SELECT key, idx, CASE WHEN idx = n - 1 THEN 0 ELSE value END AS value FROM {L}")
def lset(spark, sf):
    return lists.set_at(m.list_elems(spark, sf), -1, F.lit(0).cast("long"))


@query(f"SELECT key, nth, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS nth FROM {L} WHERE value % 2 = 0) WHERE nth <= 2")
def lpos(spark, sf):
    return lists.positions(m.list_elems(spark, sf), F.col("value") % 2 == 0, rank=-1, count=2)


@query(f"""SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM (SELECT *, CASE WHEN value % 2 = 0 THEN
row_number() OVER (PARTITION BY key, value % 2 = 0 ORDER BY idx) END AS nth FROM {L}) WHERE nth IS NULL OR nth > 1""")
def lrem(spark, sf):
    return lists.remove(m.list_elems(spark, sf), 1, F.col("value") % 2 == 0)


@query(f"""WITH l AS {L}, p AS (SELECT key, min(idx) AS place FROM l WHERE value % 2 = 0 GROUP BY key)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS idx, value FROM (SELECT key, CAST(idx AS DOUBLE) AS place, value FROM l UNION ALL SELECT key, place + 0.5, -1 FROM p)""")
def linsert(spark, sf):
    return lists.insert(m.list_elems(spark, sf), F.col("value") % 2 == 0, F.lit(-1).cast("long"), after=True)


# --- strings -----------------------------------------------------------------------------

_EV = "FROM events GROUP BY user_id"


@query(f"SELECT user_id AS key, arg_max(event_type, event_id) AS value {_EV}")
def set_last(spark, sf):
    return strings.last_write(m.op_log(spark, sf).select("key", F.col("op").alias("value"), "seq"))


@query(f"SELECT user_id AS key, arg_min(event_type, event_id) AS value {_EV}")
def setnx(spark, sf):
    return strings.first_write(m.op_log(spark, sf).select("key", F.col("op").alias("value"), "seq"))


@query("SELECT user_id AS key, event_id AS seq, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events")
def getset(spark, sf):
    return stats.previous(m.op_log(spark, sf).select("key", "seq", F.col("op").alias("value")))


@query("SELECT p.pos, p.key, d.text AS value FROM (SELECT event_id AS pos, 'doc:' || (event_id % 2000) AS key FROM events) p LEFT JOIN (SELECT 'doc:' || doc_id AS key, sha256(text) AS text FROM documents) d ON p.key = d.key")
def mget(spark, sf):
    probes = m.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("doc:"), (F.col("event_id") % 2000).cast("string")).alias("key"))
    held = m.strings(spark, sf).select("key", F.sha2("value", 256).alias("value"))
    return probes.join(held, "key", "left").select("pos", "key", "value")


@query("SELECT 'doc:' || doc_id AS key, strlen(text) AS n FROM documents")
def strlen(spark, sf):
    return m.strings(spark, sf).select("key", F.octet_length("value").cast("long").alias("n"))


@query("SELECT 'doc:' || doc_id AS key, lower(substr(hex(encode(text)), 7, 34)) AS part FROM documents")
def getrange(spark, sf):
    return m.strings(spark, sf).select("key", F.lower(F.hex(strings.get_range(F.col("value"), 3, 19))).alias("part"))


@query("SELECT 'doc:' || doc_id AS key, CASE WHEN strlen(text) = 0 THEN '' ELSE lower(right(hex(encode(text)), 20)) END AS part FROM documents")
def getrange_negative(spark, sf):
    return m.strings(spark, sf).select("key", F.lower(F.hex(strings.get_range(F.col("value"), -10, -1))).alias("part"))


@query("""SELECT key, lower(substr(h, 1, 20) || '7879' || substr(h, 25)) AS value FROM (SELECT c_custkey AS key, rpad(hex(encode(c_mktsegment)), CAST(greatest(strlen(c_mktsegment) * 2, 20) AS INTEGER), '0') AS h FROM customer)""")
def setrange(spark, sf):
    c = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.encode("c_mktsegment", "utf-8").alias("value"))
    return c.select("key", F.lower(F.hex(strings.set_range(F.col("value"), 10, b"xy"))).alias("value"))


@query(f"SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value {_EV}")
def append(spark, sf):
    return strings.append(m.op_log(spark, sf).select("key", "seq", F.col("op").alias("value")))


@query("SELECT l_orderkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def incrby(spark, sf):
    return strings.increment(m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("delta")))


@query("SELECT l_orderkey AS key, round(sum(l_extendedprice), 3) AS value FROM lineitem GROUP BY 1")
def incrbyfloat(spark, sf):
    return m.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.round(F.sum("l_extendedprice"), 3).alias("value"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS i, CASE WHEN event_id % 2 = 0 THEN 1.5 END AS f FROM events")
def parse_numbers(spark, sf):
    e = m.table(spark, sf, "events")
    return e.select("event_id", strings.parse_int(F.regexp_extract("props", "([0-9]+)", 1)).alias("i"), strings.parse_float(F.when(F.col("event_id") % 2 == 0, "+1.5").otherwise("nan")).alias("f"))


# --- keys and expiry ---------------------------------------------------------------------

K = f"""(SELECT 'user:' || user_id AS key, user_id, CASE user_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'hash' ELSE 'set' END AS type,
CASE WHEN user_id % 7 = 0 THEN 0 ELSE (epoch_us(max(ts)) // 1000) + {m.TTL_MS} END AS expire_ms, (epoch_us(max(ts)) // 1000) AS written_ms, (epoch_us(min(ts)) // 1000) AS created_ms, count(*) AS size FROM events GROUP BY user_id)"""
LATE = m.NOW_MS + 18 * 24 * 3600 * 1000
LIVE = f"(expire_ms = 0 OR expire_ms > {LATE})"


@query(f"SELECT count(*) AS n FROM {K} WHERE {LIVE}")
def dbsize(spark, sf):
    return m.keys(spark, sf).where(m.live(LATE)).agg(F.count("*").alias("n"))


@query(f"SELECT key, CASE WHEN NOT {LIVE} THEN -2 WHEN expire_ms = 0 THEN -1 ELSE CAST(ceil((expire_ms - {LATE}) / 1000) AS BIGINT) END AS ttl FROM {K}")
def ttl(spark, sf):
    return m.keys(spark, sf).select("key", F.when(m.live(LATE), keyspace.remaining(LATE, 1000)).otherwise(-2).alias("ttl"))


@query(f"SELECT key, CASE WHEN expire_ms = 0 THEN -1 ELSE expire_ms // 1000 END AS at FROM {K} WHERE {LIVE}")
def expiretime(spark, sf):
    return m.keys(spark, sf).where(m.live(LATE)).select("key", keyspace.instant(1000).alias("at"))


@query(f"SELECT key, written_ms + 86400000 * 20 AS expire_ms FROM {K} WHERE {LIVE} AND written_ms + 86400000 * 20 > {LATE}")
def expireat(spark, sf):
    return keyspace.expire_at(m.keys(spark, sf), F.col("written_ms") + 86400000 * 20, LATE).select("key", "expire_ms")


@query(f"SELECT key, CAST(CASE WHEN expire_ms <> 0 THEN 1 ELSE 0 END AS INTEGER) AS removed FROM {K} WHERE {LIVE}")
def persist(spark, sf):
    return m.keys(spark, sf).where(m.live(LATE)).select("key", (F.col("expire_ms") != 0).cast("int").alias("removed"))


@query(f"SELECT count(*) AS found FROM (SELECT 'user:' || (event_id % 300) AS key FROM events) p JOIN {K} k ON p.key = k.key WHERE {LIVE}")
def exists(spark, sf):
    probes = m.table(spark, sf, "events").select(F.concat(F.lit("user:"), (F.col("event_id") % 300).cast("string")).alias("key"))
    return keyspace.exists(m.keys(spark, sf), probes, LATE)


@query(f"SELECT count(*) AS removed FROM {K} WHERE {LIVE} AND user_id % 4 = 0")
def delete(spark, sf):
    k = m.keys(spark, sf)
    gone = k.where("user_id % 4 = 0").select("key")
    return keyspace.delete(k, gone.unionByName(gone), LATE)[1]


@query(f"SELECT p.key, coalesce(k.type, 'none') AS type FROM (SELECT 'user:' || user_id * 2 AS key FROM (SELECT DISTINCT user_id FROM events)) p LEFT JOIN (SELECT * FROM {K} WHERE {LIVE}) k ON p.key = k.key")
def type_of(spark, sf):
    probes = m.keys(spark, sf).select(F.concat(F.lit("user:"), (F.col("user_id") * 2).cast("string")).alias("key"))
    return keyspace.type_of(m.keys(spark, sf), probes, LATE)


@query(f"SELECT CASE key WHEN 'user:14' THEN 'user:renamed' ELSE key END AS key, type, expire_ms FROM {K}")
def rename(spark, sf):
    return keyspace.rename(m.keys(spark, sf), "user:14", "user:renamed").select("key", "type", "expire_ms")


@query(f"SELECT key, type, expire_ms FROM {K} UNION ALL SELECT 'user:copy', type, expire_ms FROM {K} WHERE key = 'user:14' AND {LIVE}")
def copy(spark, sf):
    return keyspace.copy(m.keys(spark, sf), "user:14", "user:copy", True, LATE).select("key", "type", "expire_ms")


@query(f"SELECT key, size, written_ms, created_ms FROM {K}")
def keysize_keystamp(spark, sf):
    return m.keys(spark, sf).select("key", "size", "written_ms", "created_ms")


@query(f"""SELECT key, size FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY written_ms, size DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {K}) WHERE before < 500""")
def reclaim(spark, sf):
    return keyspace.reclaim(m.keys(spark, sf), 500).select("key", "size")


@query(f"SELECT count(*) AS orphans FROM events e WHERE NOT EXISTS (SELECT 1 FROM {K} k WHERE k.user_id = e.user_id AND {LIVE})")
def sweep(spark, sf):
    rows = m.table(spark, sf, "events").select(F.lit(m.NS).alias("ns"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))
    return keyspace.sweep(m.keys(spark, sf), rows, LATE).agg(F.count("*").alias("orphans"))


@query(f"SELECT key, type FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM {K} WHERE {LIVE}) WHERE r BETWEEN 11 AND 40 AND type = 'hash' AND key GLOB 'user:*[0-5]'")
def scan(spark, sf):
    return keyspace.scan_page(m.keys(spark, sf).withColumn("ns", F.lit(m.NS)), glob.matches(F.col("key"), "user:*[0-5]"), "hash", 0, 10**9, LATE).join(
        keyspace.scan_page(m.keys(spark, sf), F.lit(True), None, 1, 10, LATE).unionByName(keyspace.scan_page(m.keys(spark, sf), F.lit(True), None, 2, 10, LATE)).unionByName(keyspace.scan_page(m.keys(spark, sf), F.lit(True), None, 3, 10, LATE)).select("key"),
        "key",
    )


@query(f"SELECT key FROM {K} WHERE key > 'user:30' ORDER BY key LIMIT 25")
def page_after(spark, sf):
    return keyspace.page_after(m.keys(spark, sf).select("key"), "user:30", 25)


@query(f"SELECT key, field, value FROM {H} WHERE field GLOB 'n[a-m]*'")
def hscan(spark, sf):
    return m.hash_fields(spark, sf).where(glob.matches(F.col("field"), "n[a-m]*"))


@query("SELECT p_partkey FROM part WHERE p_name GLOB '*a?e*'")
def match_glob(spark, sf):
    return m.table(spark, sf, "part").where(glob.matches(F.col("p_name"), "*a?e*")).select("p_partkey")


@query("SELECT 'doc:' || doc_id AS key, sha256(text) AS value FROM documents WHERE doc_id % 97 = 3")
def get(spark, sf):
    probes = m.table(spark, sf, "documents").where("doc_id % 97 = 3").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"))
    return m.strings(spark, sf).join(probes, "key", "left_semi").select("key", F.sha2("value", 256).alias("value"))


@query("SELECT o_custkey AS key, o_orderkey AS member FROM orders WHERE o_custkey BETWEEN 10 AND 30")
def prefix_scan(spark, sf):
    return m.zset_members(spark, sf).where(F.col("key").between(10, 30)).select("key", "member")


# --- JSON --------------------------------------------------------------------------------


@query("SELECT event_id AS key, '[' || (props->>'$.k') || ']' AS value FROM events")
def json_get(spark, sf):
    return m.json_docs(spark, sf).select("key", jsondocs.get(F.col("doc"), "$.k").alias("value"))


@query("SELECT event_id AS key, 'integer' AS type FROM events")
def json_type(spark, sf):
    return m.json_docs(spark, sf).select("key", jsondocs.type_of(F.col("doc"), "$.k").alias("type"))


@query("""SELECT event_id AS key, '{"k":' || (CAST(props->>'$.k' AS BIGINT) + 5) || '}' AS doc FROM events""")
def json_numincrby(spark, sf):
    return m.json_docs(spark, sf).select("key", jsondocs.changed(F.col("doc"), lambda d: jsondocs.add_number(d, ["k"], 5)).alias("doc"))


@query("""SELECT event_id AS key, '{"k":' || (props->>'$.k') || ',"a":[1]}' AS doc FROM events""")
def json_set(spark, sf):
    return m.json_docs(spark, sf).select("key", jsondocs.changed(F.col("doc"), lambda d: jsondocs.set_value(d, ["a"], "[1]")).alias("doc"))


@query("SELECT event_id AS key, '{}' AS doc FROM events")
def json_del(spark, sf):
    return m.json_docs(spark, sf).select("key", jsondocs.changed(F.col("doc"), lambda d: jsondocs.delete(d, ["k"])).alias("doc"))


@query("SELECT event_id AS key, CAST(2 + event_id % 2 AS INTEGER) AS n FROM events")
def json_arrlen(spark, sf):
    doc = F.when(F.col("key") % 2 == 0, '{"a":[1,2]}').otherwise('{"a":[1,2,3]}')
    return m.json_docs(spark, sf).select("key", F.json_array_length(jsondocs.get(doc, "a")).alias("n"))


@query("SELECT event_id AS key, '{\"a\":[1,2]}' AS doc FROM events")
def json_arrappend(spark, sf):
    return m.json_docs(spark, sf).select("key", jsondocs.changed(F.lit('{"a":[1]}'), lambda d: jsondocs.append(d, ["a"], ["2"])).alias("doc"))


# --- slots and balance -------------------------------------------------------------------

_SLOT = """(SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, strlen(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b << 8), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN (x & 32768) <> 0 THEN xor(x << 1, 4129) & 65535 ELSE (x << 1) & 65535 END)) % 16384 AS slot FROM {})"""
_USERS = "(SELECT DISTINCT 'user:' || user_id AS key FROM events)"


def _slotted(spark, sf):
    return m.keys(spark, sf).withColumn("slot", slots.slot(F.col("key")))


@query(f"SELECT key, slot FROM {_SLOT.format(_USERS)}")
def slot_of(spark, sf):
    return _slotted(spark, sf).select("key", "slot")


@query(f"SELECT '0' AS ns, slot, count(*) AS n FROM {_SLOT.format(_USERS)} GROUP BY slot")
def slotstats(spark, sf):
    return balance.slot_counts(_slotted(spark, sf))


@query(f"SELECT slot, count(*) AS ops FROM {_SLOT.format(_USERS)} s JOIN events e ON s.key = 'user:' || e.user_id GROUP BY slot")
def slotheat(spark, sf):
    heat = m.op_log(spark, sf).groupBy("key").agg(F.count("*").alias("ops")).withColumn("key", F.concat(F.lit("user:"), F.col("key").cast("string")))
    return heat.select(slots.slot(F.col("key")).alias("slot"), "ops").groupBy("slot").agg(F.sum("ops").alias("ops"))


@query(f"SELECT key, CASE WHEN slot = 100 THEN 'moved' WHEN slot = 5000 THEN 'odd' WHEN slot <= 8191 THEN 'a' ELSE 'b' END AS owner FROM {_SLOT.format(_USERS)}")
def slot_owner(spark, sf):
    return balance.owner(_slotted(spark, sf), [(0, 8191, "a"), (8192, 16383, "b")], {5000: "odd", 100: "odd"}, {100: "moved"}).select("key", "owner")


@query(f"SELECT key, slot * 3 // 16384 AS pair FROM {_SLOT.format(_USERS)}")
def default_owner(spark, sf):
    return _slotted(spark, sf).select("key", balance.default_owner(F.col("slot"), 3).alias("pair"))


@query(f"""SELECT slot, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT slot, count(*) AS n FROM {_SLOT.format(_USERS)} GROUP BY slot)) WHERE before < 20""")
def select_units(spark, sf):
    return balance.select_units(balance.slot_counts(_slotted(spark, sf)), 20).select("slot", "n")


@query("SELECT 'a' AS src, 'c' AS dst, CAST(600 AS BIGINT) AS amount")
def plan_moves(spark, sf):
    return spark.createDataFrame(balance.plan_moves({"a": 1600, "b": 1000, "c": 400}, 0.2), "src string, dst string, amount long")


@query("SELECT * FROM (VALUES (0, 20, 'a'), (21, 30, 'b'), (40, 50, 'b')) t(lo, hi, owner)")
def merge_runs(spark, sf):
    return balance.merge_runs(spark.createDataFrame([(0, 10, "a"), (11, 20, "a"), (21, 30, "b"), (40, 50, "b")], "lo int, hi int, owner string")).select("lo", "hi", "owner")


# --- counts, quotas, ledgers -------------------------------------------------------------


@query("SELECT '0' AS ns, event_type AS op, " + ", ".join(f"CAST(sum(CASE WHEN value * 1000 <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{b}" for b in stats.LATENCY_US) + ", count(*) AS n FROM events GROUP BY event_type")
def latency_histogram(spark, sf):
    return stats.histogram(m.op_log(spark, sf), F.col("value") * 1000).drop("total")


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def hot_keys(spark, sf):
    return stats.hot(m.op_log(spark, sf), 20)


@query(f"SELECT user_id AS key, round(sum(pow(0.5, ({LATE} - (epoch_us(ts) // 1000)) / 864000000.0)), 6) AS heat FROM events GROUP BY 1")
def decayed_heat(spark, sf):
    return stats.decayed(m.op_log(spark, sf), LATE, 864000000).withColumn("heat", F.round("heat", 6))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('error', 'click') THEN event_type ELSE 'other' END AS kind FROM events) GROUP BY kind")
def error_kinds(spark, sf):
    log = m.op_log(spark, sf).select(stats.error_kind(F.concat("op", F.lit(" something")), ("error", "click")).alias("kind"))
    return log.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, user_id AS key FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id // 10 = e.event_id // 10 AND x.event_type = 'error')")
def transactions(spark, sf):
    log = m.op_log(spark, sf).withColumn("txn", F.floor(F.col("seq") / 10))
    return stats.committed(log, F.col("op") == "error").select("seq", "key")


@query("""WITH w AS (SELECT event_id AS txn, user_id AS key, event_id AS b, event_id + 200 AS e FROM events WHERE event_type = 'signup')
SELECT txn, EXISTS (SELECT 1 FROM events x WHERE x.user_id = w.key AND x.event_id > w.b AND x.event_id < w.e AND x.event_type = 'purchase') AS aborted FROM w""")
def watch(spark, sf):
    log = m.op_log(spark, sf)
    watches = log.where("op = 'signup'").select(F.col("seq").alias("txn"), "key", F.col("seq").alias("begin"), (F.col("seq") + 200).alias("end"))
    return stats.watch_conflicts(watches, log.where("op = 'purchase'"))


@query("""SELECT l.event_id AS seq, (SELECT arg_max(r.value, r.event_id) FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'view' AND r.event_id <= l.event_id) AS value FROM events l WHERE l.event_type = 'purchase'""")
def replication_lag_as_of(spark, sf):
    log = m.op_log(spark, sf)
    left = log.where("op = 'purchase'").select("key", "seq")
    return stats.as_of(left, log.where("op = 'view'").select("key", "seq", "value"), "key", "seq", "value").select("seq", "value")


@query("SELECT e.user_id AS key, e.event_id AS seq FROM events e WHERE e.event_id % 11 = 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_id % 2 = 0 AND s.event_id >= e.event_id)")
def acked_loss(spark, sf):
    log = m.op_log(spark, sf)
    acked = log.where("seq % 11 = 0").select("key", "seq", F.lit(0).alias("acked_ms"))
    return stats.breaches(acked, log.where("seq % 2 = 0").select("key", "seq"), 1).select("key", "seq")


@query("""WITH x AS (SELECT user_id AS key, event_id AS seq, value AS free, max(CASE WHEN value < 50 OR value >= 80 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events)
SELECT x.key, x.seq, coalesce(e.value < 50, false) AS shed FROM x LEFT JOIN events e ON e.event_id = x.at""")
def disk_guard(spark, sf):
    log = m.op_log(spark, sf).select("key", "seq", F.col("value").alias("free"))
    return stats.hysteresis(log, 50, 80).select("key", "seq", "shed")


@query()
def token_bucket(spark, sf):
    return stats.token_bucket(m.op_log(spark, sf), 2.0)


@query()
def near_cache(spark, sf):
    log = m.op_log(spark, sf).select((F.col("key") % 4).alias("proxy"), "key", "seq", "ts_ms", F.when(F.col("op").isin("view", "click"), "get").otherwise("set").alias("op"), F.lit(100).cast("long").alias("size"))
    return folds.cache_simulation(log, 2000, 86_400_000)


@query("""WITH l AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'del' ELSE 'incr' END AS op, event_id % 7 AS value FROM events),
r AS (SELECT *, max(CASE WHEN op <> 'incr' THEN seq END) OVER (PARTITION BY key) AS reset FROM l)
SELECT key, CAST(sum(CASE WHEN op = 'del' THEN 0 ELSE value END) AS BIGINT) AS value FROM r WHERE reset IS NULL OR seq >= reset GROUP BY key HAVING count(*) > 1 OR max(CASE WHEN op = 'del' THEN 1 ELSE 0 END) = 0""")
def replay_counters(spark, sf):
    log = m.op_log(spark, sf).select("key", "seq", F.when(F.col("op") == "signup", "set").when(F.col("op") == "error", "del").otherwise("incr").alias("op"), (F.col("seq") % 7).alias("value"))
    return folds.counters(log)


@query("SELECT count(*) AS n FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p FROM events WHERE event_id % 100 <> 50) WHERE event_id <> p + 1")
def replica_gaps(spark, sf):
    log = m.op_log(spark, sf).where("seq % 100 <> 50").select("ns", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"))
    return folds.contiguous(log).agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, CAST(arg_max(event_id, event_id) AS BIGINT) AS value FROM events GROUP BY 1")
def replica_apply(spark, sf):
    log = m.op_log(spark, sf).select("key", "seq", F.col("seq").alias("value"))
    held = folds.apply_batch(log.where("1 = 0").select("key", "value"), -1, log.where("seq < 500"))
    return folds.apply_batch(held, 499, log.where("seq >= 300"))


# --- vectors and Bloom filters -----------------------------------------------------------

_VEC = """SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, round({}, 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({}, 6) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id < 10) WHERE rank <= 5"""
_D = "CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])"


def _vec(spark, sf, metric):
    v = m.vectors(spark, sf)
    return vectors.search(v, v.where("id < 10"), 5, metric)


@query(_VEC.format(*[f"list_cosine_similarity({_D})"] * 2))
def vec_search_cosine(spark, sf):
    return _vec(spark, sf, "cosine")


@query(_VEC.format(*[f"-pow(list_distance({_D}), 2)"] * 2))
def vec_search_l2(spark, sf):
    return _vec(spark, sf, "l2")


@query(_VEC.format(*[f"list_inner_product({_D})"] * 2))
def vec_search_ip(spark, sf):
    return _vec(spark, sf, "ip")


@query()
def vec_search_approximate(spark, sf):
    v = m.vectors(spark, sf)
    return vectors.approximate(v, v.where("id % 50 = 0"), 5, 1.0)


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vec_info(spark, sf):
    return m.vectors(spark, sf).groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))


def _items(spark, sf):
    return m.table(spark, sf, "pages").select(F.encode("url", "utf-8").alias("item"), (F.col("page_id") % 2).alias("half"))


@query("SELECT count(*) AS missed FROM pages WHERE false")
def bloom_no_false_negative(spark, sf):
    p = bloom.plan(1000, 0.01)
    items = _items(spark, sf).where("half = 0")
    return bloom.might_hold(items, bloom.build(items, p), p).where("not found").agg(F.count("*").alias("missed"))


@query()
def bloom_exists(spark, sf):
    pages = m.table(spark, sf, "pages").where("page_id % 2 = 0").select(F.encode("url", "utf-8").alias("item"), F.col("page_id").alias("at"))
    return bloom.any_holds(_items(spark, sf), bloom.chain(pages, 100_000, 0.001)).groupBy("half", "found").agg(F.count("*").alias("n"))


from keyloom.plans import lifecycle  # noqa: E402, F401 - its queries join the registry
