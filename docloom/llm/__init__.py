"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; its queries and their
SQL are in ``docloom.llm.queries``.
"""
