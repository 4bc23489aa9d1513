"""Log analytics on Spark: checksummed records in sharded segments, read and written as DataFrames."""
