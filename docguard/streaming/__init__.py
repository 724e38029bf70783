"""Structured Streaming forms of the decision plan and its counts."""
