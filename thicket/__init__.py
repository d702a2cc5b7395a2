"""Multi-block forest analytics on Spark DataFrames."""
