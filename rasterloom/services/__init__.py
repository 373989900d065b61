"""State beside the cubes: assigned tiles, stored graphs."""
