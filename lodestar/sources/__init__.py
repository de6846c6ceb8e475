"""Readers of staged raw text, and writers of results."""
