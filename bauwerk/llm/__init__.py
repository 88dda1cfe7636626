"""Operators for preparing large text and vector collections; nothing else in the library imports this."""
