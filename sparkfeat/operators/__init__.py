"""Operators: each one is a function from DataFrame(s) to a DataFrame (or a small fitted
parameter object whose fit is a single aggregate job)."""
