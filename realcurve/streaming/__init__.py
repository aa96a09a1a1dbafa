"""Structured Streaming top-up of quotes."""
