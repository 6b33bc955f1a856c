"""feuillet: parish-register analytics and text processing on Spark DataFrames."""
