"""Streaming adapters."""
