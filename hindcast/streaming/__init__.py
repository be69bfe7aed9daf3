"""Structured Streaming extensions; the batch operators don't need them."""
