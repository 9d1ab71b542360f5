"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage; deleting it leaves the extraction engine whole.
Every operator takes a DataFrame and names of its key and text columns, reads no other column, and returns
its own columns only, so extra columns (whatever their names) never clash with results.
"""
