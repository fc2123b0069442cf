"""Queries of conditional writes, vector collections, quotas, migration and event-time windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import model as m
from keyloom.functions import commands, slots
from keyloom.operators import collections, jsondocs, sets, writes, zsets
from keyloom.operators import strings as text
from keyloom.operators.keyspace import rename
from keyloom.plans.catalog import _LEX, _SLOT, _USERS, K, S, _lex, _slotted, query

# --- strings and expiry ------------------------------------------------------------------

_OPS = "CASE event_type WHEN 'view' THEN 'SET' WHEN 'click' THEN 'NX' WHEN 'purchase' THEN 'XX' ELSE 'DEL' END"
_LOG = f"(SELECT user_id AS key, event_id AS seq, {_OPS} AS op, value FROM events)"


def _writes(spark, sf):
    op = F.when(F.col("event_type") == "view", "SET").when(F.col("event_type") == "click", "NX").when(F.col("event_type") == "purchase", "XX").otherwise("DEL")
    return m.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")


@query(f"""WITH c AS (SELECT *, coalesce(max(seq) FILTER (op = 'DEL') OVER (PARTITION BY key), -1) AS cut FROM {_LOG}),
f AS (SELECT *, min(seq) FILTER (op IN ('SET', 'NX')) OVER (PARTITION BY key) AS made FROM c WHERE seq > cut)
SELECT key, arg_max(value, seq) AS value FROM f WHERE op = 'SET' OR seq = made OR (op = 'XX' AND seq > made) GROUP BY key""")
def set_conditions(spark, sf):
    return writes.conditional(_writes(spark, sf))


@query(f"""SELECT user_id AS key, coalesce(arg_max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 + {m.TTL_MS} ELSE 0 END, event_id) FILTER (event_type <> 'click'), 0)::BIGINT AS expire_ms
FROM events GROUP BY user_id""")
def set_keepttl(spark, sf):
    op = F.when(F.col("op") == "click", "KEEPTTL").when(F.col("op") == "purchase", "EXPIRE").when(F.col("op") == "signup", "PERSIST").otherwise("SET")
    return writes.expiry_after(m.op_log(spark, sf).withColumn("op", op), m.TTL_MS)


@query("SELECT p.key, d.value FROM (SELECT DISTINCT user_id * 3 AS key FROM events) p LEFT JOIN (SELECT doc_id AS key, strlen(text) AS value FROM documents) d USING (key)")
def getdel(spark, sf):
    return writes.take(*_taken(spark, sf))[0]


@query("SELECT doc_id AS key, strlen(text) AS value FROM documents WHERE doc_id NOT IN (SELECT user_id * 3 FROM events)")
def getdel_rest(spark, sf):
    return writes.take(*_taken(spark, sf))[1]


def _taken(spark, sf):
    held = m.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.octet_length("text").cast("long").alias("value"))
    return held, m.table(spark, sf, "events").select((F.col("user_id") * 3).alias("key"))


@query("SELECT o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def mset(spark, sf):
    return text.last_write(m.zset_members(spark, sf).select("key", F.col("member").alias("seq"), F.col("score").alias("value")))


@query("""SELECT event_id AS key, raw, CASE WHEN event_id % 5 IN (0, 1) THEN value END AS number FROM
(SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN '' || value WHEN 1 THEN '+' || value || 'e0' WHEN 2 THEN value || 'd' WHEN 3 THEN ' ' || value ELSE '0x1p3' END AS raw FROM events)""")
def float_arguments(spark, sf):
    value, kind = F.col("value").cast("string"), F.col("event_id") % 5
    raw = F.when(kind == 0, value).when(kind == 1, F.concat(F.lit("+"), value, F.lit("e0"))).when(kind == 2, F.concat(value, F.lit("d"))).when(kind == 3, F.concat(F.lit(" "), value)).otherwise("0x1p3")
    return m.table(spark, sf, "events").select(F.col("event_id").alias("key"), raw.alias("raw")).withColumn("number", text.parse_float(F.col("raw")))


@query("""SELECT event_id AS key, CASE event_id % 6 WHEN 0 THEN '100000000000000000000' WHEN 1 THEN '0.00001' WHEN 2 THEN 'inf' WHEN 3 THEN '-inf' WHEN 4 THEN '-123456789.5' ELSE '' || event_id END AS text FROM events""")
def score_text_extremes(spark, sf):
    kind = F.col("event_id") % 6
    score = F.when(kind == 0, 1e20).when(kind == 1, 1e-5).when(kind == 2, float("inf")).when(kind == 3, float("-inf")).when(kind == 4, -123456789.5).otherwise(F.col("event_id").cast("double"))
    return m.table(spark, sf, "events").select(F.col("event_id").alias("key"), zsets.format_score(score).alias("text"))


# --- sets and sorted sets ----------------------------------------------------------------

_KEEP = f"SELECT key, member FROM {S} WHERE key <> 'view' UNION ALL SELECT 'view', member FROM "


@query(_KEEP + f"(SELECT DISTINCT member FROM {S} WHERE key IN ('click', 'purchase'))")
def sunionstore(spark, sf):
    s = m.set_members(spark, sf)
    return sets.store(s, "view", sets.union(s, ["click", "purchase"]))


@query(_KEEP + f"(SELECT member FROM {S} WHERE key = 'view' EXCEPT SELECT member FROM {S} WHERE key = 'error')")
def sdiffstore(spark, sf):
    s = m.set_members(spark, sf)
    return sets.store(s, "view", sets.diff(s, "view", ["error"]))


@query(f"SELECT key, member FROM {S} WHERE CAST(member AS VARCHAR) LIKE '1%'")
def sscan(spark, sf):
    return m.set_members(spark, sf).where(F.col("member").cast("string").startswith("1"))


@query("SELECT o_custkey AS key, o_orderkey AS member, o_totalprice AS score FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '%7'")
def zscan(spark, sf):
    return m.zset_members(spark, sf).where(F.col("member").cast("string").endswith("7"))


@query(f"""SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS r FROM {_LEX.format('0')} WHERE member >= 'b' AND member < 'p')
WHERE r BETWEEN 2 AND 4""")
def zrevrangebylex_limit(spark, sf):
    return zsets.lex_page(_lex(spark, sf, F.lit(0)), "b", "p", open_high=True, reverse=True, offset=1, limit=3).select("key", "member")


@query(f"SELECT key, type FROM {K}")
def renamenx(spark, sf):
    """The new name is taken, so nothing changes."""
    k = m.keys(spark, sf)
    first = k.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    return rename(k, first["a"], first["b"], only_new=True).select("key", "type")


@query("SELECT c_custkey AS key, count(*) AS n FROM customer WHERE c_name LIKE 'Customer#00000%' GROUP BY 1")
def prefix_bytes(spark, sf):
    held = m.hash_fields(spark, sf).where(F.col("field") == "name")
    return held.where(F.col("value").startswith("Customer#00000")).groupBy("key").agg(F.count("*").alias("n"))


# --- JSON --------------------------------------------------------------------------------

_JSON = """(SELECT event_id AS key, CASE event_id % 4 WHEN 0 THEN '{"k":"' || event_type || '"}' WHEN 1 THEN '{"k":null}'
WHEN 2 THEN '{"k":[1,{"a":"' || event_type || '"}]}' ELSE '{"x":' || event_id || '}' END AS doc FROM events)"""


def _json(spark, sf):
    kind = F.col("event_id") % 4
    doc = F.when(kind == 0, F.concat(F.lit('{"k":"'), "event_type", F.lit('"}'))).when(kind == 1, '{"k":null}').when(kind == 2, F.concat(F.lit('{"k":[1,{"a":"'), "event_type", F.lit('"}]}')))
    return m.table(spark, sf, "events").select(F.col("event_id").alias("key"), doc.otherwise(F.concat(F.lit('{"x":'), "event_id", F.lit("}"))).alias("doc"))


@query(f"""SELECT key, CASE WHEN json_exists(doc, '$.k') THEN '[' || json_extract(doc, '$.k')::VARCHAR || ']' ELSE '[]' END AS rooted, json_extract(doc, '$.k')::VARCHAR AS legacy,
CASE WHEN json_exists(doc, '$.k[#-1]') THEN '[' || json_extract(doc, '$.k[#-1]')::VARCHAR || ']' ELSE '[]' END AS last FROM {_JSON}""")
def json_get_kinds(spark, sf):
    return _json(spark, sf).select("key", jsondocs.get(F.col("doc"), "$.k").alias("rooted"), jsondocs.get(F.col("doc"), "k").alias("legacy"), jsondocs.get(F.col("doc"), "$.k[-1]").alias("last"))


@query(f"""SELECT key, CASE json_type(doc, '$.k') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' END AS k, CASE json_type(doc, '$.k[#-1]') WHEN 'OBJECT' THEN 'object' END AS last,
CASE json_type(doc, '$.x') WHEN 'UBIGINT' THEN 'integer' END AS x FROM {_JSON}""")
def json_type_kinds(spark, sf):
    return _json(spark, sf).select("key", jsondocs.type_of(F.col("doc"), "$.k").alias("k"), jsondocs.type_of(F.col("doc"), "$.k[-1]").alias("last"), jsondocs.type_of(F.col("doc"), "$.x").alias("x"))


# --- vector collections ------------------------------------------------------------------

_VLOG = f"""(SELECT vec_id AS seq, 'c' || label AS "set", vec_id AS id, embedding, 0 AS expire_ms FROM embeddings
UNION ALL SELECT 1000000000 + vec_id, 'c' || label, vec_id, list_reverse(embedding), {m.NOW_MS} + (vec_id % 7 - 3) * 1000 FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT 2000000000 + vec_id, 'c' || label, vec_id, embedding[1:5], 0 FROM embeddings WHERE vec_id % 5 = 0)"""
_VHELD = f"""(SELECT "set", id, arg_max(embedding, seq) AS embedding, arg_max(expire_ms, seq) AS expire_ms FROM {_VLOG} WHERE len(embedding) = 64 AND "set" <> 'c9' GROUP BY 1, 2)"""


def _vectors(spark, sf):
    v = m.vectors(spark, sf).withColumn("set", F.concat(F.lit("c"), F.col("meta").cast("string")))
    row = lambda seq, embedding, expire: v.select((F.col("id") + seq).alias("seq"), "set", "id", embedding.alias("embedding"), expire.cast("long").alias("expire_ms"))
    log = row(0, F.col("embedding"), F.lit(0))
    log = log.unionByName(row(10**9, F.reverse("embedding"), F.lit(m.NOW_MS) + (F.col("id") % 7 - 3) * 1000).where("id % 3 = 0"))
    log = log.unionByName(row(2 * 10**9, F.slice("embedding", 1, 5), F.lit(0)).where("id % 5 = 0"))
    asked = v.select(F.col("id").alias("seq"), "set", F.size("embedding").alias("dim"), F.when(F.col("set") == "c9", "other").otherwise("l2").alias("metric"))
    return collections.upsert(log, collections.create(asked))


@query("""SELECT 'c' || label AS "set", CAST(min(len(embedding)) AS INTEGER) AS dim, 'l2' AS metric FROM embeddings WHERE label <> 9 GROUP BY 1""")
def vec_create(spark, sf):
    v = m.vectors(spark, sf).select(F.col("id").alias("seq"), F.concat(F.lit("c"), F.col("meta").cast("string")).alias("set"), F.size("embedding").alias("dim"))
    return collections.create(v.withColumn("metric", F.when(F.col("set") == "c9", "other").otherwise("l2")))


@query(f'SELECT "set", id, CAST(embedding[1] AS DOUBLE) AS head, CAST(expire_ms AS BIGINT) AS expire_ms FROM {_VHELD}')
def vec_set(spark, sf):
    return _vectors(spark, sf)[0].select("set", "id", F.get("embedding", F.lit(0)).cast("double").alias("head"), "expire_ms")


@query(f"""SELECT seq, "set", id, CASE WHEN "set" = 'c9' THEN 'NOSET' ELSE 'WRONGDIM' END AS reason FROM {_VLOG} WHERE "set" = 'c9' OR len(embedding) <> 64""")
def vec_refused(spark, sf):
    return _vectors(spark, sf)[1]


@query(f"""SELECT "set", id, CAST(CASE WHEN expire_ms = 0 THEN -1 WHEN expire_ms <= {m.NOW_MS} THEN -2 ELSE expire_ms - {m.NOW_MS} END AS BIGINT) AS ttl FROM {_VHELD}""")
def vec_ttl(spark, sf):
    return collections.left_ms(_vectors(spark, sf)[0], m.NOW_MS)


@query(f"""SELECT "set", count(*) AS n FROM {_VHELD} WHERE expire_ms = 0 OR expire_ms > {m.NOW_MS} GROUP BY 1""")
def vec_sweep(spark, sf):
    return collections.swept(_vectors(spark, sf)[0], m.NOW_MS).groupBy("set").agg(F.count("*").alias("n"))


# --- routing, quotas, tenants ------------------------------------------------------------


@query(f"SELECT user_id % 50 AS request, count(*) AS n, min(slot) <> max(slot) AS crossslot FROM (SELECT key, slot, CAST(substr(key, 6) AS BIGINT) AS user_id FROM {_SLOT.format(_USERS)}) GROUP BY 1")
def crossslot(spark, sf):
    return writes.one_slot(_slotted(spark, sf).withColumn("request", F.col("user_id") % 50), F.col("slot"))


@query(f"SELECT CASE WHEN slot >= 8192 THEN 'b' WHEN slot < 4096 THEN 'b' ELSE 'a' END AS holder, count(*) AS n FROM {_SLOT.format(_USERS)} GROUP BY 1")
def migrate_slots(spark, sf):
    rows = _slotted(spark, sf).withColumn("holder", F.when(F.col("slot") >= 8192, "b").otherwise("a"))
    move = lambda x: writes.migrate(x, F.col("slot"), F.col("slot") < 4096, "a", "b")
    return move(move(rows)).groupBy("holder").agg(F.count("*").alias("n"))


@query(f"SELECT slot * 8 // 16384 AS shard, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM {_SLOT.format(_USERS)} GROUP BY 1")
def dbsize_fanout(spark, sf):
    k = _slotted(spark, sf).select(F.floor(F.col("slot") * 8 / slots.SLOTS).cast("long").alias("shard"))
    each = k.groupBy("shard").agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("total"))))  # one row


@query("""SELECT source AS ns, sum(strlen(text))::BIGINT AS bytes, CASE WHEN length(source) % 2 = 0 THEN 100000 ELSE 0 END::BIGINT AS quota,
length(source) % 2 = 0 AND sum(strlen(text)) > 100000 AS over FROM documents GROUP BY source""")
def storage_quota(spark, sf):
    docs = m.table(spark, sf, "documents").groupBy(F.col("source").alias("ns")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    quota = m.table(spark, sf, "documents").select(F.col("source").alias("ns")).distinct().where(F.length("ns") % 2 == 0).withColumn("quota", F.lit(100_000).cast("long"))
    return writes.over_quota(docs, quota)


@query("""SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'write' ELSE 'other' END AS kind,
event_type = 'click' AS shed FROM events""")
def command_kinds(spark, sf):
    name = F.when(F.col("op") == "view", "get").when(F.col("op") == "click", "Set").when(F.col("op") == "purchase", "DEL").otherwise("TYPE")
    log = m.op_log(spark, sf).select("seq", name.alias("command")).withColumn("name", F.upper("command"))
    found = log.join(F.broadcast(commands.table(spark).select("name", "grows")), "name", "left")
    return found.select("seq", commands.kind(F.col("command")).alias("kind"), F.coalesce("grows", F.lit(False)).alias("shed"))


@query("""SELECT user_id AS tenant, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused, arg_max(event_type, event_id) FILTER (ok) AS state FROM
(SELECT *, epoch >= coalesce(max(epoch) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), epoch) AS ok
FROM (SELECT *, CAST(floor(value) AS BIGINT) AS epoch FROM events)) GROUP BY 1""")
def registry(spark, sf):
    """Mutations of tenants under epoch fencing: the last accepted one is a tenant's state."""
    log = m.op_log(spark, sf).select(F.col("key").alias("tenant"), "seq", "op", F.floor("value").alias("epoch"))
    ok = F.col("accepted")
    return writes.fenced(log, "tenant").groupBy("tenant").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused"), F.max_by(F.when(ok, F.col("op")), F.when(ok, F.col("seq"))).alias("state"))


@query("""WITH a AS (SELECT user_id % 4 AS replica, max(event_id) AS applied FROM events GROUP BY 1), h AS (SELECT max(event_id) AS head FROM events)
SELECT replica, applied, head - applied AS behind, (SELECT max(epoch_us(ts)) // 1000 FROM events WHERE event_id = head) - epoch_us(e.ts) // 1000 AS lag_ms FROM a, h JOIN events e ON e.event_id = a.applied""")
def replica_lag(spark, sf):
    log = m.op_log(spark, sf).select("seq", "ts_ms", "key")
    head = log.agg(F.max(F.struct("seq", "ts_ms")).alias("head"))  # one row
    applied = log.groupBy((F.col("key") % 4).alias("replica")).agg(F.max(F.struct("seq", "ts_ms")).alias("at"))
    return applied.crossJoin(F.broadcast(head)).select("replica", F.col("at.seq").alias("applied"), (F.col("head.seq") - F.col("at.seq")).alias("behind"), (F.col("head.ts_ms") - F.col("at.ts_ms")).alias("lag_ms"))


# --- event-time windows (extensions) -----------------------------------------------------


@query("""SELECT epoch_us(w) // 1000 AS start_ms, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events)
GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    e = m.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n")


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, sf):
    e = m.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")

