"""Streaming of the prose engine."""
