"""Operators for preparing training text: mixing, filters, deduplication, decontamination, sharding.

Nothing else in the package imports this folder. Each module holds one operator
with a general interface and the registered query that applies it to the test
tables; ``queries.py`` lists them.
"""
