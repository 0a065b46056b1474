"""Fixtures and queries on the driver's tables."""
