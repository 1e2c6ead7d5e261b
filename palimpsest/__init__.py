"""Evidence analytics on Spark: DataFrame-in, DataFrame-out operators for text and code corpora."""
