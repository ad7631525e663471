"""Column functions: text, units, geometry, identifiers."""
