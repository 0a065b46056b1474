"""Operators of the series engine."""
