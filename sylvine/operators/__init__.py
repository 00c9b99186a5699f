"""Relational operators: routing, probing, votes, filters, distances, documents, segments."""
