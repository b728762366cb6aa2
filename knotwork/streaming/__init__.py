"""Structured Streaming over edge streams."""
