"""Column functions on vectors and texts."""
