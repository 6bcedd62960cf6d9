"""Column expressions and Arrow functions over single values."""
