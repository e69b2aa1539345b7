"""Stored tables, file and payload readers, and incremental loads."""
