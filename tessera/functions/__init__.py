"""Column functions: floor strings, numeric parsing, target transforms, geometry."""
