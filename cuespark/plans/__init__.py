"""Timed-text plans."""
