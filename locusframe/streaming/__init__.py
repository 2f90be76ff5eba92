"""Streams: the per-site encoding is stateless and runs on text streams."""
