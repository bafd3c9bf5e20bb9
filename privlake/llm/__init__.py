"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface (columns, thresholds
and lists are parameters) and the thin ``op<N>_<name>`` query that applies it
to a whole table of the test data.  ``registry`` lists the queries.  Nothing
else in the library imports this subpackage.
"""
