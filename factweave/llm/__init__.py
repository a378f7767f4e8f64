"""Operators for preparing training text, independent of the fact-base engine."""
