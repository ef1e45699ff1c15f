"""Structured Streaming versions of the staging, revenue and login jobs."""
