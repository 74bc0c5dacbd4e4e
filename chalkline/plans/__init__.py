"""Plans of the lecture-evidence library."""
