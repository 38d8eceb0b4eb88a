"""Column expressions and driver-side functions on metadata."""
