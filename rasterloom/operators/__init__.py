"""Operators of cubes."""
