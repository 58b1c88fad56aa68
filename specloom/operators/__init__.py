"""Relational operators of the engine: catalog views, extraction, verification, validation, query views."""
