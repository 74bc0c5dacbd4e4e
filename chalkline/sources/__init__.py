"""Sources of the lecture-evidence library."""
