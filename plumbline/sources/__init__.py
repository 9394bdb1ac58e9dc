"""Readers and writers of the file shapes the analytics start from and end in."""
