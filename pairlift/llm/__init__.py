"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``queries`` lists the thin
``opN_<name>`` queries that apply each operator to its whole table.
"""
