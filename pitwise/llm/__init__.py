"""Operators for preparing language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage. Each module documents
how it treats nulls, empty and very long texts, ties, repeated rows and empty
tables.
"""
