"""Incremental refresh of a code index."""
