"""Operators of the prose engine."""
