"""Structured Streaming jobs for capture and apply."""
