"""Structured Streaming forms of chunked, stateful and windowed processing."""
