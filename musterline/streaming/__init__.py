"""Structured Streaming: sheets processed as they arrive, live status and counters."""
