"""Entity resolution and data profiling on Spark DataFrames."""
