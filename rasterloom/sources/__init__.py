"""Where cubes come from."""
