"""Incremental passes over streams of files."""
