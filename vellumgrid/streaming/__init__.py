"""Streaming forms of batch aggregates."""
