"""Operators of a training-data pipeline over ``documents``, ``labels`` and ``conversations``.

Nothing else in the library imports this package. ``queries`` binds each operator to the shared tables.
"""
