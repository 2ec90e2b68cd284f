"""Column expressions and per-series features."""
