"""Operators of a training-data pipeline over a corpus of documents.

Nothing outside this folder imports it.  Each module holds one operator with
its own interface and the ``opN_*`` query that applies it to a whole table.
"""
