"""Readers and writers of catalogues, logs and result tables."""
