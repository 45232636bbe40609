"""Operators for building training text from SQL and prose. Nothing outside this
subpackage imports it."""
