"""Column functions, and the per-page converter."""
