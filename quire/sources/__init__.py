"""Readers of document formats, as node tables."""
