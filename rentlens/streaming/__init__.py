"""Continuous form of the upload path."""
