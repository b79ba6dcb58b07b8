"""Column functions: lattice algebra, distances and keys."""
