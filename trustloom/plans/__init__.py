"""Queries: operators applied to tables, and the assembled documents."""
