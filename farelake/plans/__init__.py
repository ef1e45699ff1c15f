"""Business queries and load steps, as functions from tables to DataFrames."""
