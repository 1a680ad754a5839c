"""A pipeline of operators over Spark DataFrames that can tell which input rows made an output row."""
