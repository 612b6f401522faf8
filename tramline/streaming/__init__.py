"""Realtime observations: batch twins and Structured Streaming jobs."""
