"""Operators under Structured Streaming; an extension."""
