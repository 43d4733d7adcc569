"""Structured Streaming jobs over the hourly feed."""
