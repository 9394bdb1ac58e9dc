"""Registered queries: each runs an operator over the given tables and, where SQL can say it, has an oracle."""
