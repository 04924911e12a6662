"""Table operators: each takes DataFrames and gives DataFrames."""
