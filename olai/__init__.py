"""Letter-level lexicon search and corpus preparation on Spark DataFrames."""
