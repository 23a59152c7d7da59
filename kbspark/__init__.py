"""kbspark: analytics over mixed document and tabular knowledge, as Spark DataFrames."""
