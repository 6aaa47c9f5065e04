"""Continuous controls on Structured Streaming."""
