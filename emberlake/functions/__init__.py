"""Column expressions and task-side kernels."""
