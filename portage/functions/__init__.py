"""Column expressions for names, stamps and task parameters."""
