"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ["zrevrange", "zrangebyscore_limit", "zunionstore_sum", "zrangebylex_mixed", "sinter", "sdiff", "hset", "lrange", "lpos", "mget", "incrby", "ttl", "slotstats", "latency_histogram", "replay_counters", "replication_lag_as_of", "vec_search_cosine", "bloom_exists"]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from keyloom.plans import catalog

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    run(HEADLINE[0])  # compiles and loads what every query shares
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
