"""Column expressions on paths and texts."""
