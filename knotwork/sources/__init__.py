"""Graphs from tables and files, and sinks for clusterings."""
