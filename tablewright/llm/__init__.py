"""Operators of a training-data pipeline: packing, personal data, toxicity,
near and exact duplicates, token counts, media containers, byte-pair encoding,
chat formatting and language identification.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query for each operator.
"""
