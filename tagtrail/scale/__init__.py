"""Helpers that keep jobs even and durable: hot-key splitting, lineage cuts."""
