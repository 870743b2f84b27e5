"""Streaming forms of operators whose batch form is a fold over time."""
