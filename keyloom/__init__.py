"""keyloom: a typed keyspace held as DataFrames, with bulk operators on Spark."""
