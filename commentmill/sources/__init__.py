"""Readers, writers and the run history."""
