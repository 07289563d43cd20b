"""Registered queries: each runs an operator over the given tables and states the same result in SQL."""
