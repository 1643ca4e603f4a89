"""Operators of a training-data pipeline.

Each module holds one operator with its own general interface; ``registry`` has
the thin ``opN_<name>`` queries over the test tables and their SQL twins.
"""
