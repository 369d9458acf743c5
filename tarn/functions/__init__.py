"""Column and rank arithmetic."""
