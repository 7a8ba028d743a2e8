"""Structured Streaming: progress, totals, deduplication, frontier."""
