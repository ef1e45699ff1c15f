"""Farelake: a ride-hailing warehouse and access-control reporting, on Spark.

Public functions take DataFrames (or a mapping of table name to DataFrame) and
an explicit ``as_of`` clock, and return lazy DataFrames.
"""
