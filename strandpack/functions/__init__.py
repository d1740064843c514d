"""Column expressions and byte kernels."""
