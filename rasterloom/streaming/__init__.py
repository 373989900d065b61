"""Cubes over streams."""
