"""Annotation state kept up to date from a stream of operations."""
