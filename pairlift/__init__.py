"""Incremental item-pair association on Spark."""
