"""Typed, declarative extraction of records from HTML on Spark."""
