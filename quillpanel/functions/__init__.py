"""Column-level primitives over ordered rows of one entity."""
