"""Block-level storage analytics on Spark: files, blocks, tensors and archives as DataFrames."""
