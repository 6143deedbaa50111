"""Operators over trial tables: rows (keys ..., x array<double>[, y array<double>])."""
