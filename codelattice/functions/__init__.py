"""Column helpers over paths, names and texts."""
