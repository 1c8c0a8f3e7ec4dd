"""Queries over the provided tables, each with the SQL that checks it."""
