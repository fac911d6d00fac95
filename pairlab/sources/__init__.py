"""Readers and writers: sequences, pair tables, embedding tables, feature caches, results."""
