"""Readers, writers and bar adapters."""
