"""Versioned tables, commits, imports and retention."""
