"""Column-to-column functions and the pattern vocabulary."""
