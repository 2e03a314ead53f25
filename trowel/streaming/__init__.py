"""Structured Streaming forms of the kernels that make sense on an unbounded event log."""
