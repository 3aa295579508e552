"""Column-level functions (pure expressions, no data access)."""
