"""Readers, writers and the staging area in the shared folder."""
