"""Event-data and training-data operators on Spark DataFrames."""
