"""Operators on evaluated and raw frames."""
