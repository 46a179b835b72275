"""Operators: each a function from DataFrame to DataFrame."""
