"""Readers for parser results, provider and model tables, and the media table."""
