"""Traffic-session refinement and analytics on Spark DataFrames."""
