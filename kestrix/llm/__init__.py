"""Operators of a training-data pipeline over document tables.

Each module holds one operator with a general interface; `queries.py` holds the
thin registered queries (`opN_<name>`). Nothing outside this subpackage imports it.
"""
