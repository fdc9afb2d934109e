"""Operators on Structured Streaming sources."""
