"""Readers and writers for the file layouts of the pipeline."""
