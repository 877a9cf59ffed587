"""Operators for training-data pipelines over documents, pages and embeddings.

Every operator is a function from DataFrames to a DataFrame. The registered
queries and their SQL are in ``gridcast.llm.queries`` and ``gridcast.llm.sql``.
"""
