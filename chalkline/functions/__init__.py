"""Functions of the lecture-evidence library."""
