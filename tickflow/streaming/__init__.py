"""Structured Streaming sinks, triggers and fan-out."""
