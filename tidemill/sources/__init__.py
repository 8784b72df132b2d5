"""Readers, writers and normalisers of market data."""
