"""Spark jobs for residence-hall data."""
