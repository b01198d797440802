"""Structured Streaming forms of the operators, and idempotent sinks."""
