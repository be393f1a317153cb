"""Readers and parsers of log lines."""
