"""strandline: market-evidence and training-data analytics on Spark DataFrames."""
