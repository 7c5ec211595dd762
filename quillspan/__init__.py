"""Registry linkage, graph features and mismatch scoring on Spark DataFrames."""
