"""Keyspace analytics on Spark: data-structure commands evaluated set-at-a-time over DataFrames."""
