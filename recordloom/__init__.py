"""Record formats as Spark DataFrames: a lossless envelope of every record, and typed columns to query."""
