"""Relational operators of corpus preparation, retrieval, evaluation and reporting."""
