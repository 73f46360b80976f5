"""Readers, normalisers and table adapters."""
