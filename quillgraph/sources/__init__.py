"""Readers of notes, logs and plain files as DataFrames."""
