"""Column expressions and grouped statistics."""
