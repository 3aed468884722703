"""Operators of a training-data pipeline, each over whole tables.

Nothing outside this subpackage imports it.
"""
