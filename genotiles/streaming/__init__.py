"""Structured Streaming forms of the example source, transforms and metric state."""
