"""Claim verification analytics on Spark: extract, resolve, label, aggregate."""
