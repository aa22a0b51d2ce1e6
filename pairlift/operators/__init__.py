"""Operators from DataFrame to DataFrame, for batch and micro-batch alike."""
