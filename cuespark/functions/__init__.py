"""Timed-text functions."""
