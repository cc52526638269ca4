"""Operators for preparing training text: one module per operator, queries and SQL in ``queries``.

Nothing outside this folder imports it.
"""
