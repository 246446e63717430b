"""Relational operators of record linkage: blocking, retrieval, context windows, decisions, evaluation, features."""
