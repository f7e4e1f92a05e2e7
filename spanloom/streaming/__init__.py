"""Streaming of spanloom."""
