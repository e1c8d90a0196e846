"""Readers and writers of the text formats, all through Spark's own sources."""
