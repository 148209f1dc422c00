"""Column functions: geometry, projection, text and JSON."""
