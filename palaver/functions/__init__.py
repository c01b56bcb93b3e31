"""Scalar functions as Column builders; Python only where no expression exists."""
