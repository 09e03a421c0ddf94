"""Training-data operators for document corpora, built on Spark DataFrames."""
