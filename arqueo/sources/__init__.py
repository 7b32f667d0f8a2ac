"""Readers and writers of files outside Spark's own formats, and strict readers of those."""
