"""Queries over the given tables, each next to the SQL that gives the same rows."""
