"""Readers and keyed snapshot tables."""
