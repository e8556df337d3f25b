"""foliograph: documents as tables, on Spark DataFrames."""
