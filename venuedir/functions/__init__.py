"""Scalar column expressions. Every one is a built-in Spark expression tree."""
