"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the thin ``opN_*`` queries built on them are
in :mod:`lexiloom.llm.queries`.
"""
