"""Scalar functions and value semantics."""
