"""Registered queries (Spark) and their DuckDB oracle SQL."""
