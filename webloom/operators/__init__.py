"""Operators over DataFrames of pages."""
