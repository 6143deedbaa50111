"""Synthetic trial sources."""
