"""Expectations on data."""
