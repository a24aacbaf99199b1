"""Structured Streaming variants of the batch operators."""
