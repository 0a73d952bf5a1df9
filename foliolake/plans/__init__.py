"""Deterministic planning: splits, layouts, samples, augmentation, resume and reports."""
