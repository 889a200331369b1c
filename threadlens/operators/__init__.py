"""Relational operators.  Each takes and returns DataFrames."""
