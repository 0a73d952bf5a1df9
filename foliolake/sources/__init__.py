"""Readers and writers of manifests, rasters, samples and reports."""
