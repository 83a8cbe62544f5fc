"""Column functions for text, paths, maps and units."""
