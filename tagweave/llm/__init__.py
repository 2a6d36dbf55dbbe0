"""Operators of a training-data pipeline (dedup, scoring, packing, extraction).

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; the registered queries and their SQL twins are in
:mod:`tagweave.llm.queries`.
"""
