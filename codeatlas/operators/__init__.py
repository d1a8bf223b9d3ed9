"""Operators: a CodeIndex and parameters in, a DataFrame out."""
