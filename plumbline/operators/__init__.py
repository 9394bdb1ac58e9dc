"""Relational operators over claims, quotations, corpora and verdict records."""
