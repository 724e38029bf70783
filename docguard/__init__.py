"""Screening of document collections for prompt injection, as DataFrame operators on Spark."""
