"""Streaming of the lecture-evidence library."""
