"""chunkloom: content-addressed data processing on Spark DataFrames."""
