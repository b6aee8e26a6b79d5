"""Column functions: contexts, per-read counts, strands, exact tests."""
