"""tracelith: profiler-trace analytics on Spark DataFrames."""
