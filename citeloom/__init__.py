"""citeloom: document-reference analytics and corpus preparation on Spark DataFrames."""
