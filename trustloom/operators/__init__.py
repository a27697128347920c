"""Assurance operators over raw tables."""
