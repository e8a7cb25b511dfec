"""Structured Streaming over event tables (an extension of the engine's batch metrics)."""
