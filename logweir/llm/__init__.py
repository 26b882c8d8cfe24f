"""Operators of a training-data pipeline: one module each, their queries in ``catalog``.

Nothing else in the package imports this folder.
"""
