"""weftline: cross-text semantic search and text reuse on Spark DataFrames."""
