"""Structured Streaming sources, connectors and stateful operators."""
