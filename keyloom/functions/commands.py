"""Which commands read, write, or grow what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of the commands; some names (HMGET, HKEYS, HVALS, TYPE) are in neither list
READS = """GET MGET EXISTS TTL PTTL EXPIRETIME PEXPIRETIME STRLEN GETRANGE HSTRLEN HGET HGETALL HLEN HEXISTS SISMEMBER SMISMEMBER
SRANDMEMBER HSCAN SSCAN ZSCAN SCAN SCARD SMEMBERS SINTER SUNION SDIFF LLEN LRANGE LINDEX LPOS ZSCORE ZCARD ZRANGE ZREVRANGE ZRANGEBYSCORE
ZREVRANGEBYSCORE ZRANGEBYLEX ZREVRANGEBYLEX ZLEXCOUNT ZRANK ZREVRANK ZCOUNT ZMSCORE DBSIZE JSON.GET JSON.TYPE JSON.ARRLEN BF.EXISTS
BF.MEXISTS BF.CARD BF.INFO""".split()
WRITES = """SET SETNX SETEX MSET COPY ZUNIONSTORE ZINTERSTORE SINTERSTORE SUNIONSTORE SDIFFSTORE ZREMRANGEBYLEX RENAME RENAMENX DEL EXPIRE
PEXPIRE EXPIREAT PEXPIREAT UNLINK GETDEL GETEX GETSET HSETNX PERSIST INCR DECR INCRBY DECRBY INCRBYFLOAT APPEND SETRANGE FLUSHALL HSET HDEL
HINCRBY SADD SREM SPOP LPUSH RPUSH LPOP RPOP LSET LTRIM LREM LINSERT ZADD ZREM ZINCRBY ZPOPMIN ZPOPMAX ZREMRANGEBYSCORE ZREMRANGEBYRANK
JSON.SET JSON.DEL JSON.FORGET JSON.NUMINCRBY JSON.ARRAPPEND BF.ADD BF.MADD BF.RESERVE BF.INSERT""".split()
#: writes that a namespace over its quota may still send
RELIEF = ["DEL", "UNLINK", "FLUSHALL", "EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"]


def kind(name: Column) -> Column:
    """read, write, or other (which stays with the master)."""
    upper = F.upper(name)
    return F.when(upper.isin(WRITES), "write").when(upper.isin(READS), "read").otherwise("other")


def table(spark: SparkSession) -> DataFrame:
    """The dimension table: name, kind, grows. Some hundred rows."""
    rows = [(x, "write", x not in RELIEF) for x in WRITES] + [(x, "read", False) for x in READS]
    return spark.createDataFrame(rows, "name string, kind string, grows boolean")
