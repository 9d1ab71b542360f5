"""From program text to a checked, immutable plan."""
