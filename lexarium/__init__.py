"""Keyword extraction over tables of documents, as lazy DataFrame plans.

Documents are rows of (doc_id, text). Operators on single texts are keyed by
doc_id, operators on a corpus by an optional corpus key.
"""
