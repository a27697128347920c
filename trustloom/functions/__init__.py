"""Reusable column functions."""
