"""Column functions: seeded draws, scores, pixel values, paths and canonical JSON."""
