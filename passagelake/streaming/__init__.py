"""Structured Streaming: the snapshot diff as a micro-batch."""
