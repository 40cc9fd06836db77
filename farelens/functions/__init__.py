"""Column expressions and statistics kernels."""
