"""Operators of a training-data pipeline.

Each module is one operator with its own general interface; ``queries`` has the thin ``opN_<name>`` queries over the
tables of a data folder. Nothing outside this subpackage imports it.
"""
