"""Batch readers, writers, merges and inventory operators."""
