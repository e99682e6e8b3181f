"""Readers, exports and append-only tables."""
