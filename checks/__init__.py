"""Queries over the given tables, and the SQL that must give the same rows."""
