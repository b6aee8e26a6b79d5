"""Operators of a training-data pipeline: each module holds one operator.

``_queries`` binds them to the tables of a data folder; nothing outside this
subpackage imports it.
"""
