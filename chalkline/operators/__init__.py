"""Operators of the lecture-evidence library."""
