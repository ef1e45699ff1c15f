"""Reusable table operators: latest row, neighbours, versions, keys, checks, access rules."""
