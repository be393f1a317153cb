"""Operators over fact DataFrames."""
