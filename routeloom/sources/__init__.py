"""Readers of source repositories and of stored JSON artifacts."""
