"""seqmine: gap-constrained frequent-sequence mining on Spark DataFrames."""
