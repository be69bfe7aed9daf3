"""Scalar functions as Spark columns, and text functions."""
