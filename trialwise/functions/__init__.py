"""Column functions: row-wise mathematics and signal windows."""
