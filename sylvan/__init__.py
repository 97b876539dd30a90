"""Tree queries and template transforms over Spark DataFrames."""
