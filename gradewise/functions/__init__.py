"""Column-level functions (pure expressions, no jobs)."""
