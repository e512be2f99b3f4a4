"""Operators: DataFrame in, DataFrame (or a small fitted model) out."""
