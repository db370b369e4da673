"""Schema-less Protocol Buffers wire analytics on Spark DataFrames."""
