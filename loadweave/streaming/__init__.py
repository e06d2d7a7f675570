"""Structured Streaming jobs on arriving load payloads."""
