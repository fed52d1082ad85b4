"""Column functions and type inference."""
