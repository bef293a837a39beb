"""Structured Streaming forms of scoring and de-duplication."""
