"""Readers of interactions."""
