"""Whole computations and the catalogue of queries."""
