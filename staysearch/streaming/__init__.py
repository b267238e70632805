"""Structured Streaming jobs that keep the store up to date."""
