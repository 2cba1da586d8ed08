"""Research analytics over Spark DataFrames."""
