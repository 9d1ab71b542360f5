"""The built-in transforms, in Python and as Column expressions."""
