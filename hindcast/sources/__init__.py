"""Readers and writers of the panel's inputs and results."""
