"""Operators that prepare text corpora and vectors for training language models."""
